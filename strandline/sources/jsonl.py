"""Readers: JSON lines in three modes of strictness, concatenated objects with repair, CSV with aliases, configuration."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType

from ..functions.arrays import unalias
from ..functions.text import candidate_tools, narrow_punctuation, outermost_object, strip

#: Fixed value: the key that takes stray text in a repair.
THOUGHTS = "思考"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, grp, id, line): physical lines numbered from 1 in each file; grp is the file's name without its ending. Files are read whole, as
    line numbers need it; for large files without a need for numbers use ``spark.read.text``."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("grp"), "value")
    rows = whole.select("path", "grp", F.posexplode(F.split("value", "\n")).alias("pos", "line"))
    return rows.select("path", "grp", (F.col("pos") + 1).cast("long").alias("id"), F.regexp_replace("line", "\r$", "").alias("line"))


@F.pandas_udf(BooleanType())
def strict_object(line: pd.Series) -> pd.Series:
    """Whether a line is one JSON object and nothing else."""

    def one(text):
        try:
            return isinstance(json.loads(text), dict)
        except (TypeError, ValueError, RecursionError):
            return False

    return line.map(one).astype(bool)


def parse(rows: DataFrame, schema: str, mode: str = "quarantine", line: str = "line") -> tuple[DataFrame, DataFrame]:
    """(good, bad) from rows with a JSON line each. ``skip`` drops bad lines, ``quarantine`` returns them, ``failfast`` raises with the numbers
    of the first. Blank lines are left out."""
    filled = rows.where(strip(F.col(line)) != "").withColumn("__ok", strict_object(F.col(line)))
    good = filled.where("__ok").withColumn("value", F.from_json(line, schema)).drop("__ok")
    bad = filled.where("not __ok").drop("__ok")
    if mode == "failfast" and (found := bad.limit(5).collect()):
        raise ValueError("; ".join(f"line {r['id']}: {r[line][:80]}" for r in found))
    if mode not in ("skip", "quarantine", "failfast"):
        raise ValueError(f"no such mode: {mode}")
    return good, bad if mode == "quarantine" else bad.limit(0)


def objects_in(text: str) -> Iterator[str]:
    """The top-level {...} in a text, braces inside strings aside. A stray closing brace is passed over, an object that never ends comes out as it is."""
    depth, begin, quoted, escaped = 0, 0, False, False
    for m in re.finditer(r'[{}"\\]', text):
        c, at = m[0], m.start()
        if escaped and at == escaped:
            escaped = False
            continue
        escaped = False
        if c == "\\":
            escaped = at + 1 if quoted else False
        elif c == '"' and depth:
            quoted = not quoted
        elif not quoted and c == "{":
            begin = at if depth == 0 else begin
            depth += 1
        elif not quoted and c == "}" and depth:
            depth -= 1
            if not depth:
                yield text[begin : at + 1]
    if depth:
        yield text[begin:]


@F.pandas_udf(ArrayType(StringType()))
def scan_objects(text: pd.Series) -> pd.Series:
    return text.map(lambda x: list(objects_in(x or "")))


@F.pandas_udf(StringType())
def absorb_tail(fragment: pd.Series) -> pd.Series:
    """A last attempt: stray strings between the list of thoughts and the closing brace are taken into the list."""

    def one(text):
        if not text or THOUGHTS not in text:
            return None
        head, _, tail = text.rpartition("]")
        body = tail.rstrip().rstrip("}").strip().strip(",").strip()
        if not body:
            return None
        candidate = f"{head}, {json.dumps(body.strip(chr(34)), ensure_ascii=False)}]" + "}"
        try:
            json.loads(candidate)
        except ValueError:
            return None
        return candidate

    return fragment.map(one)


def repair(fragments: DataFrame, column: str = "fragment") -> DataFrame:
    """``fragments`` with json (the first attempt that parses, or null) and attempt (1 to 4): as it is; narrow punctuation and no
    backticks; the outermost braces of that; stray text taken in."""
    raw = F.col(column)
    second = strip(narrow_punctuation(F.replace(raw, F.lit("`"), F.lit(""))))
    tries = [raw, second, outermost_object(second), absorb_tail(second)]
    out = fragments.withColumns({f"__t{k}": t for k, t in enumerate(tries)})
    which = F.coalesce(*[F.when(strict_object(F.col(f"__t{k}")), k + 1) for k in range(4)])
    out = out.withColumn("attempt", which)
    return out.withColumn("json", F.coalesce(*[F.when(F.col("attempt") == k + 1, F.col(f"__t{k}")) for k in range(4)])).drop(*[f"__t{k}" for k in range(4)])


def read_grouped(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad) objects of all files under a path, with grp (file stem) and pos: concatenated objects, repaired where possible."""
    whole = spark.read.text(path, wholetext=True).select(F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("grp"), "value")
    found = repair(whole.select("grp", F.posexplode(scan_objects("value")).alias("pos", "fragment")))
    return found.where("json is not null"), found.where("json is null")


def read_csv(spark: SparkSession, path: str, required: list[str], aliases: dict[str, str] | None = None) -> DataFrame:
    """CSV with a header, a byte-order mark or none, quoted line ends; columns renamed by alias, required ones checked."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    names = [(aliases or {}).get(n.lstrip("﻿").strip('"'), n.lstrip("﻿").strip('"')) for n in df.columns]
    df = df.toDF(*names)
    if lacking := [c for c in required if c not in names]:
        raise ValueError(f"columns are missing: {lacking}")
    return df


def catalog_frame(spark: SparkSession, tools: dict[str, dict]) -> DataFrame:
    """A tool catalog, an ordered object of a few entries, as rows; blank descriptions raise ValueError."""
    if not tools or any(not (t.get("description") or "").strip() for t in tools.values()):
        raise ValueError("the catalog is empty, or a description is blank")
    rows = [(i, n, t["description"], t.get("text_augmentation") or [], t.get("enhanced_description")) for i, (n, t) in enumerate(tools.items())]
    return spark.createDataFrame(rows, "index int, tool_name string, description string, text_augmentation array<string>, enhanced_description string")


def labelled_violations(rows: DataFrame, allowed: list[str], unique_questions: bool = False) -> DataFrame:
    """(rule, id) for rows (id, line) of labelled questions that break the contract: a blank line, broken JSON, no question, no gold tool, an unknown one, and a question met
    before, if they have to differ. ``allowed`` is a small catalog."""
    parsed = F.from_json("line", "query string, gold_tools array<string>")
    known = F.array(*map(F.lit, allowed))
    gold = F.coalesce(F.col("v.gold_tools"), F.array().cast("array<string>"))
    blank = strip(F.col("line")) == ""
    ok = ~blank & strict_object(F.col("line"))
    checked = rows.withColumn("v", parsed).select("id", F.col("v.query").alias("query"), F.array_compact(F.array(
        F.when(blank, "blank line"), F.when(~blank & ~ok, "not an object"), F.when(ok & (strip(F.coalesce("v.query", F.lit(""))) == ""), "no question"),
        F.when(ok & (F.size(gold) == 0), "no gold tool"), F.when(ok & (F.size(F.array_except(gold, known)) > 0), "unknown tool"),
    )).alias("rules"))
    found = checked.select(F.explode("rules").alias("rule"), "id")
    if unique_questions:
        asked = checked.where("query is not null and trim(query) <> ''")
        first = asked.groupBy("query").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        found = found.union(asked.join(first, "query").where("id > first").select(F.lit("question met before"), "id"))
    return found


def sft_source(rows: DataFrame, kind: str, allowed: list[str], aliases: dict[str, str] | None = None) -> DataFrame:
    """id, query, tools, corrected, removed, rule of SFT source rows (id, line with query and 工具): aliases are put right and counted, tools met before in a list are taken
    out and counted; rule names what is broken first: an unknown tool, or a number of tools that ``kind`` (single or multi) doesn't allow."""
    tools = F.from_json("line", "`query` string, `工具` array<string>")
    known = F.array(*map(F.lit, allowed))
    out = rows.withColumn("v", tools).withColumn("raw", F.coalesce(F.col("v.`工具`"), F.array().cast("array<string>"))).withColumn("right", unalias(F.col("raw"), aliases))
    out = out.withColumn("tools", F.array_distinct("right"))
    n = F.size("tools")
    rule = F.when(F.size(F.array_except("tools", known)) > 0, "unknown tool").when(n != 1 if kind == "single" else n < 2, "number of tools")
    corrected = F.size(F.filter(F.arrays_zip("raw", "right"), lambda z: z["raw"] != z["right"]))
    return out.select("id", F.col("v.query").alias("query"), "tools", corrected.alias("corrected"), (F.size("right") - n).alias("removed"), rule.alias("rule"))


def alpaca_rows(rows: DataFrame) -> DataFrame:
    """id, question, candidates, gold, rule of Alpaca lines (id, line): exactly the keys instruction, input, output, none blank, candidates listed in the input, gold tools in the
    output."""
    v = F.from_json("line", "instruction string, input string, output string")
    keys = F.array_sort(F.json_object_keys("line"))
    filled = lambda c: strip(F.coalesce(c, F.lit(""))) != ""
    out = rows.withColumn("v", v).withColumn("candidates", candidate_tools(F.col("v.input")))
    gold = F.from_json("v.output", "`工具` array<string>")["工具"]
    out = out.withColumn("gold", gold)
    rule = F.when(~F.coalesce(keys == F.array(F.lit("input"), F.lit("instruction"), F.lit("output")), F.lit(False)), "keys").when(~(filled(F.col("v.instruction")) & filled(F.col("v.input")) & filled(F.col("v.output"))), "blank")
    rule = rule.when(F.size("candidates") < 1, "no candidates").when(F.coalesce(F.size("gold"), F.lit(0)) < 1, "no gold")
    question = strip(F.substring_index(F.col("v.input"), "【用户问题】", -1))
    return out.select("id", question.alias("question"), "candidates", "gold", rule.alias("rule"))
