from callscope.llm.secrets import redact, scan


def test_secrets_are_whole():
    for secret in ["kQ7mZp2Xv9Lr4Tn8Ws3Bd/6Yh1Gc5Jf0Ra+Uq", "6Yh1Gc5Jf0Ra-kQ7mZp2Xv9Lr4Tn8Ws3Bd_Uq", "ghp_kQ7mZp2Xv9Lr4Tn8Ws3Bd6Yh1Gc5Jf0Ra"]:
        assert scan(f"key {secret} end")[1] == [(4, 4 + len(secret), "entropy")]
        assert redact(f"key {secret} end") == "key [secret] end"


def test_parts_beside_a_base_span_stay():
    run, digest = "kQ7mZp2Xv9Lr4Tn8Ws3BdX", "0123456789abcdef" * 2
    base, spans = scan(f"{run}/{digest}/Q9x")
    assert base == [(23, 55, "hex")] and spans == [(0, 23, "entropy"), (23, 55, "hex"), (55, 59, "entropy")]
