"""Personal data by candidate gradient boosting, with DataFrame functions only.

High-recall generators, several for a kind, propose spans, which may overlap. Boosted
trees, compiled to one SQL expression, score each candidate by its format (digits,
separators, groups, check digits) and its context (what stands before it). A
threshold for each kind, calibrated for precision, and the odds among overlapping
candidates select what is added to the base kinds, whose patterns and checks are fixed.

The trees are fitted on the driver on a bounded set of generated, labelled examples
(`Training.examples`), whose features come from the same SQL expressions; there are
no labelled spans in the data, so precision and recall of the thresholds are those of
held-out generated examples, and `audit` counts how many spans added in real documents
pass checks that no feature sees. Executors run no Python.

Patterns are written possessively, with look-behinds that skip starts inside a run,
so that the matches are those of the plain patterns and time is linear in the text.

Defined results: a null text is empty and has no span; spans are in code points, end
exclusive; an added span never overlaps a base span or another added span, and of
overlapping candidates the one of the higher odds stays (the longer, the first); repeated rows are scanned alike; an empty table gives an empty result.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------- base kinds

#: The base kinds in their order: what a text must hold to be searched, and the pattern.
BASE = {
    "email": ("@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]++\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"[0-9](?:[\x20-]?+[0-9]){12}", r"[0-9](?:[\x20-]?+[0-9])++"),
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def located(text: Column, needs: str, pattern: str) -> tuple[Column, Column]:
    """(matches, pieces between them) of a text; both empty if it doesn't hold `needs`."""
    found = text.rlike(needs)
    none = F.array().cast("array<string>")
    return F.when(found, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none), F.when(found, F.split(text, pattern, -1)).otherwise(none)


#: Elements of a block of `running`.
BLOCK = 64


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with the value computed once, however often `of` looks at it (in a lambda, say)."""
    return F.transform(F.array(value), of)[0]


def running(values: Column, combine: Callable[[Column, Column], Column], start: int) -> Column:
    """array<int>: what combine (associative) makes of an array's elements up to each one.

    An array in an aggregate's state is copied at each step, so blocks are combined
    first, then their heads are carried, then each block runs on from its head.
    """
    carry = F.struct(F.lit(start).alias("at"), F.array().cast("array<int>").alias("out"))

    def of_block(block: Column, head: Column) -> Column:
        return F.transform(block, lambda _, i: F.aggregate(F.slice(block, F.lit(1), i + 1), head, combine))

    def of_blocks(blocks: Column) -> Column:
        heads = F.aggregate(
            F.transform(blocks, lambda block: F.aggregate(block, F.lit(start), combine)), carry,
            lambda acc, total: F.struct(combine(acc["at"], total).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"],
        )
        return F.flatten(F.zip_with(blocks, heads, of_block))

    def of_values(held: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(held) - 1) / BLOCK).cast("int")), lambda b: F.slice(held, b * BLOCK + 1, F.lit(BLOCK)))
        return F.when(F.size(held) > 0, let(blocks, of_blocks)).otherwise(F.array().cast("array<int>"))

    return let(values, of_values)


PLACE = "struct<s:int,e:int,m:string,before:string>"


def with_places(matches: Column, pieces: Column) -> Column:
    """array<struct<s, e, m, before>> of the matches; before: up to CONTEXT characters of the match before and what lies between."""
    widths = F.zip_with(F.slice(pieces, F.lit(1), F.size(matches)), matches, lambda p, m: F.length(p) + F.length(m))
    ends = running(widths, Column.__add__, 0)

    def place(e: Column, i: Column) -> Column:
        m = F.get(matches, i)
        last = F.coalesce(F.get(matches, i - 1), F.lit(""))
        before = F.right(F.concat(F.right(last, F.lit(CONTEXT)), F.right(F.get(pieces, i), F.lit(CONTEXT))), F.lit(CONTEXT))
        return F.struct((e - F.length(m)).alias("s"), e.alias("e"), m.alias("m"), before.alias("before"))

    return F.when(F.size(matches) > 0, F.transform(ends, place)).otherwise(F.array().cast(f"array<{PLACE}>"))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the check: every second digit from the right is doubled."""
    places = F.sequence(F.lit(1), F.length(number))

    def value(k: Column) -> Column:
        d = F.substr(number, F.length(number) - k + 1, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(k % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.when(F.length(number) > 0, F.aggregate(places, F.lit(0), lambda acc, k: acc + value(k)) % 10 == 0).otherwise(False)


def passes(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        n = F.length(digits(m))
        return n.between(13, 19) & luhn(F.when(n.between(13, 19), digits(m)).otherwise("0"))
    if kind == "phone":
        return F.length(digits(m)).between(9, 15)
    return F.lit(True)


# ---------------------------------------------------------------- candidates

#: Generators, high in recall and low in precision: kind, what a text must hold to be searched, pattern. Spans of different generators may overlap.
CANDIDATES = (
    ("social", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"),
    ("local_phone", r"[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}", r"(?<![0-9A-Za-z(])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-]?)[0-9]{3}[ .-]?[0-9]{4}(?![0-9A-Za-z])"),
    ("local_phone", r"[0-9]{3}[ .-][0-9]{4}", r"(?<![0-9A-Za-z])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])"),
    ("local_phone", r"0[0-9]{1,4}[ /.-][0-9]{2}", r"(?<![0-9A-Za-z])0[0-9]{1,4}+(?:[ /.-][0-9]{2,8}+){1,5}+(?![0-9A-Za-z])"),
    ("number", r"[0-9][0-9 ()./-]{5,}[0-9]", r"(?<![0-9A-Za-z])\(?[0-9](?:[ ()./-]{0,2}+[0-9]){6,18}+(?![0-9A-Za-z])"),
    ("account", r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?+[A-Z0-9]{4}){2,7}+(?: ?+[A-Z0-9]{1,3})?+(?![0-9A-Za-z])"),
    ("account", r"[A-Z]{2}[0-9]{2}[A-Z0-9]{8}", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}[A-Z0-9]{8,30}+(?![0-9A-Za-z])"),
    ("account", r"[A-Z]{2}[0-9]{2} [A-Z0-9]{4}", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: [A-Z0-9]{4}){2,7}+(?![0-9A-Za-z])"),
    ("ipv6", r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:", r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+){5,7}+(?![0-9A-Za-z:])"),
    ("ipv6", r"[0-9A-Fa-f]::[0-9A-Fa-f]", r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+){0,5}+::[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+){0,5}+(?![0-9A-Za-z:])"),
    ("written_email", r"(?i)(?: at |\(at\)|\[at\])", r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{2,64}+ ?+(?:at|\(at\)|\[at\]) ?+[a-z0-9-]{2,63}+(?:\.[a-z]{2,24}+| ?+(?:\(dot\)|\[dot\]) ?+[a-z]{2,24}+| dot [a-z]{2,24}+)++"),
)
KINDS = tuple(dict.fromkeys(kind for kind, _, _ in CANDIDATES))
HINTS = r"(?i)(?:phone|tel|call|mobile|cell|fax|contact|ssn|social security|iban|account|passport|e-?mail|write to|reach|dob|born|nummer|número|téléphone|konto)[^0-9]{0,12}$"
WRONG = r"(?i)(?:order|invoice|isbn|version|page|price|total|no\.|id|ref|date|since|year|serial|part)[^0-9]{0,12}$"
CONTEXT = 28

#: Features in order.
FEATURES = ("n_digits", "n_chars", "n_spaces", "n_hyphens", "n_dots", "n_slashes", "n_brackets", "is_date", "hint", "wrong", "luhn", "n_letters", "brackets_at", "groups", "in_list", *(f"is_{kind}" for kind in KINDS))


def features(x: Column) -> list[Column]:
    m, before = x["m"], x["before"]
    count = lambda pattern: (F.length(m) - F.length(F.regexp_replace(m, pattern, ""))).cast("double")
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    number = digits(m)
    return [
        F.length(number).cast("double"), F.length(m).cast("double"), count(" "), count("-"), count(r"\."), count("/"), count(r"[()\[\]]"),
        flag(m.rlike(r"^(?:[0-9]{4}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4})(?:[ -].*)?$")),
        flag(before.rlike(HINTS)), flag(before.rlike(WRONG)),
        flag(F.length(number).between(13, 19) & luhn(F.when(F.length(number).between(13, 19), number).otherwise("0"))),
        count("[A-Za-z]"), flag(m.rlike(r"(?i)(?:[(\[]at|[ (\[]dot\b|[)\]])")), count("(?<=[0-9A-Za-z])[^0-9A-Za-z]"),
        flag(before.rlike("[0-9]{3}[ .-][0-9]{4}[ ,;/]{1,3}$")),
        *(flag(x["kind"] == k) for k in range(len(KINDS))),
    ]


# ---------------------------------------------------------------- boosted trees


@dataclass(frozen=True)
class Training:
    """examples: generated texts, half of them personal data. precision: what a kind's threshold must reach on the calibration half."""

    examples: int = 2400
    rounds: int = 24
    rate: float = 0.4
    precision: float = 0.98
    seed: int = 7


@dataclass(frozen=True)
class Split:
    feature: int
    at: float
    low: object
    high: object


def _best_split(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray) -> tuple[float, int, float]:
    best = (0.0, -1, 0.0)
    whole = gradient.sum() ** 2 / (hessian.sum() + 1.0)
    for f in range(x.shape[1]):
        for at in np.unique(np.quantile(x[:, f], np.linspace(0, 1, 17)[1:-1], method="lower")):
            low = x[:, f] <= at
            if low.all() or not low.any():
                continue
            gain = gradient[low].sum() ** 2 / (hessian[low].sum() + 1.0) + gradient[~low].sum() ** 2 / (hessian[~low].sum() + 1.0) - whole
            if gain > best[0] + 1e-9:
                best = (gain, f, float(at))
    return best


def _grow(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, depth: int, rate: float) -> object:
    gain, f, at = _best_split(x, gradient, hessian) if depth else (0.0, -1, 0.0)
    if f < 0:
        return float(rate * gradient.sum() / (hessian.sum() + 1.0))
    low = x[:, f] <= at
    return Split(f, at, _grow(x[low], gradient[low], hessian[low], depth - 1, rate), _grow(x[~low], gradient[~low], hessian[~low], depth - 1, rate))


def evaluate(tree: object, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, Split):
        return np.full(len(x), tree)
    return np.where(x[:, tree.feature] <= tree.at, evaluate(tree.low, x), evaluate(tree.high, x))


def boost(x: np.ndarray, y: np.ndarray, training: Training) -> list[object]:
    """Trees of depth 3 for the log-odds, by second-order gradient boosting of the logistic loss."""
    trees, odds = [], np.zeros(len(y))
    for _ in range(training.rounds):
        p = 1 / (1 + np.exp(-odds))
        trees.append(_grow(x, y - p, p * (1 - p), 3, training.rate))
        odds += evaluate(trees[-1], x)
    return trees


def as_column(tree: object, fields: Column) -> Column:
    if not isinstance(tree, Split):
        return F.lit(tree)
    return F.when(fields[FEATURES[tree.feature]] <= tree.at, as_column(tree.low, fields)).otherwise(as_column(tree.high, fields))


@dataclass(frozen=True)
class Model:
    """trees: one sum of trees for all kinds. thresholds: odds for each kind. precision, recall: of the calibration half, for each kind."""

    trees: list[object]
    thresholds: dict[str, float]
    precision: dict[str, float]
    recall: dict[str, float]


# ---------------------------------------------------------------- generated examples


def examples(training: Training) -> list[tuple[int, str, set[tuple[str, int, int]]]]:
    """(number, text, the personal data that it holds as kind, start, end), from rules."""
    rng = random.Random(training.seed)
    word = lambda: "".join(rng.choice(["an", "er", "tion", "le", "do", "en", "ver", "ar", "sch", "on"]) for _ in range(rng.randint(1, 3)))
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    h = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(1, 4)))
    yes = [
        ("local_phone", lambda: rng.choice(["phone ", "Tel: ", "call me on ", "mobile ", "contact: ", "fax ", "reach us at ", ""]), lambda: rng.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}"])),
        ("local_phone", lambda: rng.choice(["phone ", "Tel. ", "call ", "mobile: "]), lambda: rng.choice([f"0{d(2)} {d(7)}", f"0{d(3)}/{d(6)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"{d(3)}-{d(4)}"])),
        ("social", lambda: rng.choice(["SSN ", "social security ", ""]), lambda: f"{d(3)}-{d(2)}-{d(4)}"),
        ("account", lambda: rng.choice(["IBAN ", "account ", "Konto ", ""]), lambda: rng.choice([f"DE{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(2)}", f"FR{d(20)}", f"ES{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(4)}"])),
        ("number", lambda: rng.choice(["passport ", "account ", "phone ", "call "]), lambda: d(rng.choice([7, 8, 9, 11]))),
        ("ipv6", lambda: rng.choice(["from ", "host ", ""]), lambda: rng.choice([":".join(h() for _ in range(8)), f"2001:{h()}::{h()}:{h()}:{d(4)}", f"fe80::{h()}:{h()}:{h()}:{d(3)}"])),
        ("written_email", lambda: rng.choice(["write to ", "e-mail ", "contact ", ""]), lambda: rng.choice([f"{word()}.{word()} (at) {word()} (dot) com", f"{word()} [at] {word()}.org", f"{word()}{d(2)} at {word()} dot net"])),
    ]
    no = [
        lambda: rng.choice(["on ", "since ", "date ", ""]) + rng.choice([f"20{d(2)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", f"{rng.randint(10, 28)}.{rng.randint(10, 12)}.20{d(2)}", f"{rng.randint(1, 9)}/{rng.randint(10, 28)}/20{d(2)}"]),
        lambda: rng.choice(["order ", "invoice ", "ref ", "serial ", "total ", ""]) + d(rng.randint(7, 16)),
        lambda: f"ISBN 978-{d(1)}-{d(2)}-{d(6)}-{d(1)}",
        lambda: " ".join(d(rng.randint(1, 3)) for _ in range(rng.randint(4, 9))),
        lambda: " ".join(d(w) for w in [rng.randint(2, 4)] * rng.randint(3, 8)),
        lambda: rng.choice(["version ", "item ", ""]) + f"{d(2)}.{d(2)}.{d(4)}",
        lambda: rng.choice(["item ", "pages ", ""]) + f"{d(3)}-{d(4)}",
        lambda: f"{word()} at {word()} dot. {word()}",
        lambda: f"part AB{d(2)} {word().upper()[:4].ljust(4, 'X')} {word().upper()[:4].ljust(4, 'X')}",
        lambda: f"{d(2)}:{d(2)}:{d(2)}:{d(2)}:{d(2)}:{d(2)}",
        lambda: f"a::{rng.choice('bcdef')} or {rng.choice('abc')}::{d(1)}",
        lambda: f"met {word()} at {word()}.{word()} again",
    ]
    after = lambda: rng.choice(["", "", f" 20{d(2)}", f" {d(3)}"])
    out = []
    for k in range(training.examples):
        head, tail = " ".join(word() for _ in range(rng.randint(0, 6))), " ".join(word() for _ in range(rng.randint(0, 6)))
        if k % 2:
            kind, hint, value = rng.choice(yes)
            text, spans = f"{head} {hint()}", set()
            for _ in range(rng.randint(1, 3) if kind == "local_phone" and rng.random() < 0.3 else 1):  # some are lists of numbers
                own = value()
                text += rng.choice([" ", ", ", "; ", " / "]) if spans else ""
                spans.add((kind, len(text), len(text) + len(own)))
                text += own
            out.append((k, f"{text}{after()} {tail}", spans))
        else:
            out.append((k, f"{head} {rng.choice(no)()} {tail}", set()))
    return out


SPAN = "struct<kind:int,s:int,e:int,m:string,before:string>"


def _passing(kind: str) -> Column:
    return F.filter(f"x_{kind}", lambda x: passes(kind, x["m"]))


def _of_kind(number: int, places: Column) -> Column:
    return F.transform(places, lambda x: F.struct(F.lit(number).alias("kind"), *(x[c].alias(c) for c in ("s", "e", "m", "before"))))


def _candidates(df: DataFrame) -> DataFrame:
    """df with `_found`, the candidates of `_t` of all generators, by kind."""
    for k, (_, needs, pattern) in enumerate(CANDIDATES):
        matches, pieces = located(F.col("_t"), needs, pattern)
        df = df.withColumns({f"_m{k}": matches, f"_p{k}": pieces})
    arrays = []
    for k, (kind, _, _) in enumerate(CANDIDATES):
        arrays.append(_of_kind(KINDS.index(kind), with_places(F.col(f"_m{k}"), F.col(f"_p{k}"))))
    some = reduce(Column.__or__, (F.size(f"_m{k}") > 0 for k in range(len(CANDIDATES))))
    found = F.when(some, F.concat(*arrays)).otherwise(F.array().cast(f"array<{SPAN}>"))
    return df.withColumn("_found", found).drop(*(f"_{c}{k}" for c in "mp" for k in range(len(CANDIDATES))))


def _fields(x: Column) -> Column:
    return F.struct(*(c.alias(n) for n, c in zip(FEATURES, features(x))))


_FITTED: dict[Training, Model] = {}


def fit(spark: SparkSession, training: Training = Training()) -> Model:
    """Fit on the generated examples; once for a process. A candidate is right if its kind and span are those of the example."""
    if training in _FITTED:
        return _FITTED[training]
    made = examples(training)
    rows = spark.createDataFrame([(k, text) for k, text, _ in made], "k int, _t string")
    found = _candidates(rows).select("k", F.explode("_found").alias("x")).select("k", F.col("x.kind").alias("own"), F.col("x.s").alias("s"), F.col("x.e").alias("e"), _fields(F.col("x")).alias("f"))
    got = sorted(found.collect(), key=lambda r: (r["k"], r["own"], r["s"], r["e"]))
    x = np.array([list(r["f"]) for r in got], float)
    y = np.array([(KINDS[r["own"]], r["s"], r["e"]) in made[r["k"]][2] for r in got], float)
    own, half = np.array([r["own"] for r in got]), np.array([r["k"] % 4 < 2 for r in got], bool)
    trees = boost(x[half], y[half], training)
    odds = sum(evaluate(t, x) for t in trees)
    thresholds, precision, recall = {}, {}, {}
    for k, kind in enumerate(KINDS):
        mine = ~half & (own == k)
        o, right = odds[mine], y[mine]
        # The lowest odds, even at least, from which the calibration half is precise enough.
        thresholds[kind] = float("inf")
        for at in np.unique(o[o >= 0])[::-1]:
            if right[o >= at].mean() >= training.precision:
                thresholds[kind] = float(at) - 1e-9
        taken = o >= thresholds[kind]
        precision[kind] = float(right[taken].mean()) if taken.any() else float("nan")
        recall[kind] = float(right[taken].sum() / right.sum()) if right.any() else float("nan")
    _FITTED[training] = Model(trees, thresholds, precision, recall)
    return _FITTED[training]


# ---------------------------------------------------------------- scan

CHOSEN = "struct<kind:int,s:int,e:int,m:string,odds:double>"


def _all_spans(base: Column, scored: Column) -> Column:
    """Base spans (kind -1) and candidates by their starts."""
    return F.array_sort(F.concat(
        F.transform(base, lambda x: F.struct(x["s"].alias("s"), F.lit(-1).alias("kind"), x["e"].alias("e"), F.lit("").alias("m"), F.lit(0.0).alias("odds"))),
        F.transform(scored, lambda x: F.struct(*(x[c].alias(c) for c in ("s", "kind", "e", "m", "odds")))),
    ))


def _free(spans: Column) -> Column:
    """The candidates that overlap no base span."""
    never = 2**31 - 1
    ends = F.transform(spans, lambda x: F.when(x["kind"] < 0, x["e"]).otherwise(0))
    starts = F.transform(spans, lambda x: F.when(x["kind"] < 0, x["s"]).otherwise(never))
    far = running(ends, lambda a, b: F.greatest(a, b), 0)
    near = F.reverse(running(F.reverse(starts), lambda a, b: F.least(a, b), never))
    edges = F.zip_with(far, near, lambda f, n: F.struct(f.alias("far"), n.alias("near")))
    both = F.zip_with(spans, edges, lambda x, y: F.struct(x.alias("x"), ((x["kind"] >= 0) & (y["far"] <= x["s"]) & (y["near"] >= x["e"])).alias("ok")))
    return F.transform(F.filter(both, lambda b: b["ok"]), lambda b: F.struct(*(b["x"][c].alias(c) for c in ("kind", "s", "e", "m", "odds"))).cast(CHOSEN))


def _best(free: Column) -> Column:
    """Of candidates that hang together by overlaps, walked from left to right, those of the higher odds."""
    empty = F.array().cast(f"array<{CHOSEN}>")
    better = lambda x, h: (x["odds"] > h["odds"]) | ((x["odds"] == h["odds"]) & (x["e"] - x["s"] > h["e"] - h["s"]))

    def walk(acc: Column, x: Column) -> Column:
        apart = acc["held"].isNotNull() & (x["s"] >= acc["held"]["e"])
        held = F.when(acc["held"].isNull() | apart | better(x, acc["held"]), x).otherwise(acc["held"])
        return F.struct(held.alias("held"), F.when(apart, F.concat(acc["out"], F.array(acc["held"]))).otherwise(acc["out"]).alias("out"))

    def cluster(bounds: Column) -> Column:
        start = F.struct(F.lit(None).cast(CHOSEN).alias("held"), empty.alias("out"))
        return F.aggregate(F.slice(free, bounds["first"] + 1, bounds["n"]), start, walk, lambda acc: F.concat(acc["out"], F.array(acc["held"])))

    def of_ends(ends: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(free) - 1)
        firsts = F.filter(places, lambda i: F.get(free, i)["s"] >= F.coalesce(F.get(ends, i - 1), F.lit(0)))
        bounds = lambda first: F.transform(first, lambda f, j: F.struct(f.alias("first"), (F.coalesce(F.get(first, j + 1), F.size(free)) - f).alias("n")))
        return F.flatten(F.transform(let(firsts, bounds), cluster))

    return F.when(F.size(free) > 0, let(running(F.transform(free, lambda x: x["e"]), lambda a, b: F.greatest(a, b), 0), of_ends)).otherwise(empty)


def _chosen(base: Column, scored: Column) -> Column:
    """The candidates that stay, by start: none overlaps a base span, and where some overlap, going from left to right, the one of the higher odds stays (of equal ones the longer, then the first).

    Candidates that hang together by overlaps are a cluster; each cluster is walked for itself.
    """
    chosen = let(_all_spans(base, scored), lambda spans: let(_free(spans), _best))
    return F.when(F.size(scored) > 0, chosen).otherwise(F.array().cast(f"array<{CHOSEN}>"))


def found_spans(docs: DataFrame, training: Training = Training()) -> DataFrame:
    """doc_id, x_<kind> (the spans of each base kind) and _added (the chosen candidates) of every row."""
    model = fit(docs.sparkSession, training)
    df = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("_t"))
    for kind, (needs, pattern) in BASE.items():
        matches, pieces = located(F.col("_t"), needs, pattern)
        df = df.withColumns({f"m_{kind}": matches, f"p_{kind}": pieces})
    df = df.select("doc_id", "_t", *(with_places(F.col(f"m_{kind}"), F.col(f"p_{kind}")).alias(f"x_{kind}") for kind in BASE))
    df = df.withColumns({f"x_{kind}": _passing(kind) for kind in BASE})
    df = _candidates(df).drop("_t")
    odds = lambda x: reduce(Column.__add__, (as_column(t, x["f"]) for t in model.trees))
    with_fields = F.transform("_found", lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), _fields(x).alias("f")))
    with_odds = F.transform(with_fields, lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), odds(x).alias("odds")))
    least = F.array(*(F.lit(model.thresholds[kind]) for kind in KINDS))
    nothing = F.array().cast(f"array<{CHOSEN}>")
    df = df.withColumn("_scored", F.when(F.size("_found") > 0, F.filter(with_odds, lambda x: x["odds"] >= F.get(least, x["kind"]))).otherwise(nothing))
    base = F.concat(*(f"x_{kind}" for kind in BASE))
    return df.select("doc_id", *(f"x_{kind}" for kind in BASE), let(F.col("_scored"), lambda scored: _chosen(base, scored)).alias("_added"))


def scan(docs: DataFrame, training: Training = Training()) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of every row."""
    df = found_spans(docs, training)
    named = lambda c, kind: F.transform(c, lambda x: F.concat(F.lit(f"{kind}:"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string")))
    base = F.concat(*(named(F.col(f"x_{kind}"), kind) for kind in BASE))
    names = F.array(*map(F.lit, KINDS))
    added = F.transform("_added", lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["s"].cast("string"), x["e"].cast("string")))
    df = df.select("doc_id", *(F.size(f"x_{kind}").cast("long").alias(f"n_{kind}") for kind in BASE), base.alias("_spans"), added.alias("_more"))
    return df.select("doc_id", *(f"n_{kind}" for kind in BASE), F.sha2(F.array_join("_spans", ","), 256).alias("base_sha256"), F.array_join(F.concat("_spans", "_more"), ",").alias("spans"))


# ---------------------------------------------------------------- audit


def mod97(account: Column) -> Column:
    """What the check digits of an account number give: 1 if they are right."""
    plain = F.regexp_replace(account, " ", "")
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        v = F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
        return F.when(v > 9, acc * 100 + v).otherwise(acc * 10 + v) % 97

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step)


#: Checks that no feature sees: ranges that numbers of the kind never use, and check digits.
AUDITS: dict[str, Callable[[Column], Column]] = {
    "social": lambda m: ~m.rlike("^(?:000|666|9..)|-00-|-0000$"),
    "account": lambda m: mod97(m) == 1,
    "local_phone": lambda m: F.when(F.length(digits(m)) == 10, digits(m).rlike("^(?:0|[2-9]..[2-9])")).otherwise(True),
}


def audit(docs: DataFrame, training: Training = Training()) -> DataFrame:
    """kind, n (spans added in docs) and n_valid (those that pass the kind's check in AUDITS; null for kinds without one)."""
    spans = found_spans(docs, training).select(F.explode("_added").alias("x")).select(F.get(F.array(*map(F.lit, KINDS)), F.col("x.kind")).alias("kind"), F.col("x.m").alias("m"))
    valid = reduce(lambda c, kind: c.when(F.col("kind") == kind, AUDITS[kind](F.col("m"))), AUDITS, F)
    return spans.withColumn("ok", valid.cast("long")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("ok").alias("n_valid"))
