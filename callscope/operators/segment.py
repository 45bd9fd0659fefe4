"""Static and dynamic lines of a group's prompts, and value templates of the dynamic ones."""

from __future__ import annotations

import math
import pickle
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callscope.functions.text import lines, tokens
from callscope.runtime import beside, cut, shuffle_partitions

#: Fixed values.
STATIC_FRACTION = 0.9
TOP_DYNAMIC = 200
MINER_SIMILARITY, MINER_DEPTH, MINER_LINES = 0.4, 4, 4000
EXAMPLES = 3
WILDCARD = "<*>"


def line_split(prompts: DataFrame, keys: list[str], text: str = "text", fraction: float = STATIC_FRACTION) -> DataFrame:
    """(keys, line, doc_frequency, calls, kind) of every distinct line of a group; static if at least `fraction` of its prompts hold it."""
    sizes = prompts.groupBy(*keys).agg(F.count(F.lit(1)).alias("calls"))
    found = prompts.select(*keys, F.explode(F.array_distinct(lines(F.col(text)))).alias("line")).groupBy(*keys, "line").agg(F.count(F.lit(1)).alias("doc_frequency"))
    return found.join(sizes, keys).withColumn("kind", F.when(F.col("doc_frequency") >= fraction * F.col("calls"), "static").otherwise("dynamic"))


def modal_text(prompts: DataFrame, keys: list[str], text: str = "text", pos: str = "pos") -> DataFrame:
    """(keys, text, count) of each group's most common whole text, the first seen on a tie."""
    counted = prompts.groupBy(*keys, text).agg(F.count(F.lit(1)).alias("count"), F.min(pos).alias("_first"))
    best = F.max_by(F.struct(text, "count"), F.struct("count", -F.col("_first")))
    return counted.groupBy(*keys).agg(best.alias("b")).select(*keys, f"b.{text}", "b.count")


def longest_text(prompts: DataFrame, keys: list[str], text: str = "text", pos: str = "pos") -> DataFrame:
    """(keys, text) of each group's longest text, the first on a tie."""
    return prompts.groupBy(*keys).agg(F.max_by(text, F.struct(F.length(text), -F.col(pos))).alias(text))


def segmentation(prompts: DataFrame, keys: list[str], text: str = "text", pos: str = "pos") -> DataFrame:
    """One row for each group: static lines in the order of its modal text, most frequent dynamic lines, and character totals over distinct lines."""
    split = line_split(prompts, keys, text)
    place = F.row_number().over(Window.partitionBy(*keys, "kind").orderBy(F.col("doc_frequency").desc(), "line"))
    totals = split.groupBy(*keys).agg(
        F.sum(F.when(F.col("kind") == "static", F.length("line")).otherwise(0)).alias("static_chars"), F.sum(F.when(F.col("kind") == "dynamic", F.length("line")).otherwise(0)).alias("dynamic_chars"),
        F.collect_list(F.when(F.col("kind") == "static", F.col("line"))).alias("_static"),
    )
    top = split.withColumn("_n", place).where((F.col("kind") == "dynamic") & (F.col("_n") <= TOP_DYNAMIC)).groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "line"))), lambda x: x["line"]).alias("dynamic_lines"))
    out = modal_text(prompts, keys, text, pos).join(totals, keys).join(top, keys, "left")
    static = F.filter(lines(F.col(text)), lambda x: F.array_contains("_static", x))
    return out.select(*keys, static.alias("static_lines"), F.coalesce("dynamic_lines", F.array().cast("array<string>")).alias("dynamic_lines"), "static_chars", "dynamic_chars")


def call_split(prompts: DataFrame, keys: list[str], split: DataFrame, call: str = "request_id", text: str = "text") -> DataFrame:
    """(call, static_tokens, dynamic_tokens, dynamic_share): every line of a call looked up among its group's static lines."""
    rows = prompts.select(*keys, call, F.explode(lines(F.col(text))).alias("line"))
    static = split.where(F.col("kind") == "static").select(*keys, "line", F.lit(True).alias("_static"))
    found = rows.join(static, [*keys, "line"], "left")
    chars = found.groupBy(call).agg(F.sum(F.when(F.col("_static"), F.length("line")).otherwise(0)).alias("s"), F.sum(F.when(F.col("_static"), 0).otherwise(F.length("line"))).alias("d"))
    return chars.select(call, tokens(F.col("s")).alias("static_tokens"), tokens(F.col("d")).alias("dynamic_tokens"), F.round(F.try_divide(F.col("d"), F.col("s") + F.col("d")), 4).alias("dynamic_share"))


# ---------------------------------------------------------------- value templates


@dataclass
class _Node:
    children: dict = field(default_factory=dict)
    groups: list = field(default_factory=list)


class TemplateMiner:
    """Templates of log lines from a fixed-depth tree: by number of words, then leading words, then likeness."""

    def __init__(self, similarity: float = MINER_SIMILARITY, depth: int = MINER_DEPTH, width: int = 100):
        self.similarity, self.depth, self.width, self.root = similarity, depth - 2, width, {}

    def _leaf(self, words: list[str], make: bool) -> _Node | None:
        node = self.root.setdefault(len(words), _Node()) if make else self.root.get(len(words))
        for word in words[: self.depth]:
            if node is None:
                return None
            key = WILDCARD if any(c.isdigit() for c in word) else word
            if key not in node.children:
                if make and len(node.children) < self.width - 1:
                    node.children[key] = _Node()
                else:
                    key = WILDCARD
                    if make:
                        node.children.setdefault(key, _Node())
            node = node.children.get(key)
        return node

    def _best(self, node: _Node | None, words: list[str]) -> list[str] | None:
        best, most = None, (-1.0, -1)
        for group in node.groups if node else []:
            same = sum(a == b for a, b in zip(group, words))
            score = (same / len(words) if words else 1.0, group.count(WILDCARD))
            if score > most:
                best, most = group, score
        return best if most[0] >= self.similarity else None

    def add(self, line: str) -> None:
        words = line.split()
        node = self._leaf(words, True)
        group = self._best(node, words)
        if group is None:
            node.groups.append(list(words))
        else:
            group[:] = [a if a == b else WILDCARD for a, b in zip(group, words)]

    def match(self, line: str) -> str | None:
        words = line.split()
        node = self._leaf(words, False)
        for group in node.groups if node else []:
            if all(a in (b, WILDCARD) for a, b in zip(group, words)):
                return " ".join(group)
        return None


def wildcard_values(template: str, line: str) -> list[str]:
    """What a template's wildcards stand for in a line."""
    pattern = r"\s+".join("(.+?)" if w == WILDCARD else re.escape(w) for w in template.split(" "))
    found = re.fullmatch(pattern, line.strip())
    return list(found.groups()) if found else []


FIELDS_DDL = "key string, template string, occurrences long, examples array<string>, avg_value_chars long, scaffold_chars long"


#: Lines of a key, and their characters, that are matched as one group; groups that a task reads where shuffle partitions are few.
MATCHED_LINES, MATCHED_CHARS, MATCHED_GROUPS = 50_000, 16_000_000, 4


def large_keys(rows: DataFrame, train_lines: int) -> DataFrame:
    """(_key, _last, _parts) of keys with many rows (key, pos, line): a bound for the first `train_lines` by pos, and in how many groups the rows are matched.

    The bound is the train_lines-th of the first positions of twice as many buckets. Each of these is a row's own, so as many
    rows lie within it, and by the hash some 1.4 times as many: what one task ranks doesn't grow with the table.
    """
    narrow = rows.select("key", "pos", F.pmod(F.xxhash64("pos"), F.lit(2 * train_lines)).alias("_bucket"), F.length("line").alias("_chars"))
    firsts = narrow.groupBy("key", "_bucket").agg(F.min("pos").alias("_first"), F.count(F.lit(1)).alias("_n"), F.sum("_chars").alias("_chars"))
    last = F.try_element_at(F.sort_array(F.collect_list("_first")), F.lit(train_lines))
    parts = F.ceil(F.greatest(F.sum("_n") / MATCHED_LINES, F.sum("_chars") / MATCHED_CHARS)).cast("int")
    return firsts.groupBy(F.col("key").alias("_key")).agg(last.alias("_last"), parts.alias("_parts")).where(F.col("_last").isNotNull() | (F.col("_parts") > 1))


def mine_fields(dynamic: DataFrame, train_lines: int = MINER_LINES) -> DataFrame:
    """Value templates of each key's lines: rows (key, pos, line); pos only orders.

    Templates are learned from a key's first `train_lines` lines by pos; every line is matched, and lines that no
    template matches are counted under a null template. Empty and null lines are left out. A key's lines are
    matched in groups of about MATCHED_LINES; examples are the first values by pos, however lines are dealt. Keys are
    never null here: a null key is one of its own.
    """
    lines_of = dynamic.where(F.col("line").isNotNull() & (F.col("line") != ""))
    known = beside(cut(large_keys(lines_of, train_lines)))  # has a row only for keys with thousands of lines
    with_known = lambda df: df.join(known, F.col("key").eqNullSafe(F.col("_key")), "left")
    near = with_known(lines_of).where(F.coalesce(F.col("pos") <= F.col("_last"), F.lit(True))).select("key", "pos", "line")
    place = F.row_number().over(Window.partitionBy("key").orderBy("pos", "line"))

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        miner = TemplateMiner()
        for line in rows.sort_values("_n")["line"]:
            miner.add(line)
        return pd.DataFrame({"key": [rows["key"].iloc[0]], "miner": [pickle.dumps(miner)]})

    learned = near.withColumn("_n", place).where(F.col("_n") <= train_lines).groupBy("key").applyInPandas(learn, "key string, miner binary")
    dealt = with_known(lines_of).select("key", "pos", "line", F.coalesce(F.pmod(F.xxhash64("pos"), F.col("_parts")).cast("int"), F.lit(0)).alias("_part"))
    partitions = math.ceil((known.agg(F.sum("_parts")).first()[0] or 0) / MATCHED_GROUPS)
    if partitions > shuffle_partitions(dynamic.sparkSession):
        dealt = dealt.repartition(partitions, "key", "_part")
    sent = with_known(learned).select("key", "miner", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)).alias("_part"))

    def match(rows: pd.DataFrame, miners: pd.DataFrame) -> pd.DataFrame:
        columns = ["key", "template", "n", "heads", "chars", "values"]
        if not len(rows):
            return pd.DataFrame({c: [] for c in columns})
        miner, found = pickle.loads(miners["miner"].iloc[0]), {}
        order = [tuple(p.values()) if isinstance(p, dict) else p for p in rows["pos"]]  # pos may be a struct
        for k, (_, line, pos) in enumerate(sorted(zip(order, rows["line"], rows["pos"]), key=lambda x: x[:2])):
            template = miner.match(line)
            own = found.setdefault(template, {"n": 0, "heads": [], "chars": 0, "values": 0})
            values = [] if template is None else wildcard_values(template, line)
            if values and own["values"] < EXAMPLES:
                own["heads"].append({"pos": pos, "k": k, "found": values[:EXAMPLES]})
            own["n"] += 1
            own["chars"] += sum(map(len, values))
            own["values"] += len(values)
        return pd.DataFrame([{"key": rows["key"].iloc[0], "template": t, **own} for t, own in found.items()], columns=columns)

    keys = lambda df: df.groupBy("key", "_part")
    heads = f"array<struct<pos:{lines_of.schema['pos'].dataType.simpleString()},k:long,found:array<string>>>"
    parts = keys(dealt).cogroup(keys(sent)).applyInPandas(match, f"key string, template string, n long, heads {heads}, chars long, values long")
    values = F.flatten(F.transform(F.sort_array(F.flatten(F.collect_list("heads"))), lambda x: x["found"]))  # a few a group, in order; equal positions are in one group
    whole = parts.groupBy("key", "template").agg(F.sum("n").alias("occurrences"), F.slice(values, 1, EXAMPLES).alias("examples"), F.sum("chars").alias("_chars"), F.sum("values").alias("_values"))
    scaffold = F.length(F.replace("template", F.lit(WILDCARD), F.lit(""))).cast("long")
    average = F.when(F.col("_values") > 0, F.expr("_chars div _values")).otherwise(F.lit(0).cast("long"))
    ordered = whole.orderBy("key", F.col("occurrences").desc(), "template")  # a row for each template, no lines
    return ordered.select("key", "template", "occurrences", "examples", average.alias("avg_value_chars"), F.coalesce(scaffold, F.lit(0).cast("long")).alias("scaffold_chars"))
