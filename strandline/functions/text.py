"""String, template and number functions: Column -> Column."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the data contract: full-width punctuation and its repair, keyword separators, true words.
WIDE, NARROW = "，：“”、　", ',:"",' + " "
SEPARATORS = r"[,，;；\s]+"
TRUE_WORDS = ("1", "true", "yes", "y", "是", "对", "t")
#: Labels of the two classes and the words they are told by.
SHOP, CHAT = "电商类", "闲聊类"
SHOP_WORD, CHAT_WORD = "电商", "闲聊"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends (trim takes blanks only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def remove_fences(c: Column) -> Column:
    """Without Markdown fences, wherever they stand."""
    return strip(F.replace(F.replace(c, F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")))


def strip_outer_fence(c: Column) -> Column:
    """Without one fence at the start and one at the end."""
    return strip(F.regexp_replace(F.regexp_replace(strip(c), r"^```(?:json)?", ""), r"```$", ""))


def strip_think(c: Column) -> Column:
    """Without think blocks, then without stray think tags."""
    return strip(F.regexp_replace(F.regexp_replace(c, r"(?is)<think>.*?</think>", ""), r"(?i)</?think>", ""))


def strip_tags(c: Column) -> Column:
    """Without tags, white space runs as one blank."""
    return strip(F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]*>", " "), r"\s+", " "))


def narrow_punctuation(c: Column) -> Column:
    return F.translate(c, WIDE, NARROW)


def split_keywords(c: Column) -> Column:
    """The keywords of a string; null gives none."""
    return F.when(c.isNull(), F.array().cast("array<string>")).otherwise(F.filter(F.transform(F.split(c, SEPARATORS), strip), lambda x: x != ""))


def join_keywords(c: Column) -> Column:
    return F.array_join(F.filter(F.transform(c, strip), lambda x: x != ""), "，")


def contains_any(c: Column, words) -> Column:
    low = F.lower(c)
    out = F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w))
    return out


def outermost_object(c: Column) -> Column:
    """From the first opening to the last closing brace, or the empty string."""
    return F.regexp_extract(c, r"(?s)\{.*\}", 0)


def salvage(c: Column) -> Column:
    """Label and keywords from broken JSON, by their keys."""
    return F.struct(
        F.nullif(F.regexp_extract(c, r'"类型"\s*:\s*"([^"]*)"', 1), F.lit("")).alias("label"),
        F.filter(F.regexp_extract_all(F.regexp_extract(c, r'(?s)"关键词"\s*:\s*\[([^\]]*)\]', 1), F.lit(r'"([^"]+)"'), 1), lambda x: x != "").alias("keywords"),
    )


def fallback_label(c: Column) -> Column:
    return F.when(F.contains(c, F.lit(SHOP_WORD)), SHOP).when(F.contains(c, F.lit(CHAT_WORD)), CHAT)


def block_between(c: Column, begin: str, end: str) -> Column:
    """Text after the first ``begin`` and before the next ``end``."""
    return F.split_part(F.substr(c, F.locate(begin, c) + len(begin)), F.lit(end), F.lit(1))


def candidate_tools(prompt: Column, begin: str = "【候选工具】", end: str = "【用户问题】") -> Column:
    """The tools that a prompt lists, in order."""
    return F.regexp_extract_all(block_between(prompt, begin, end), F.lit(r"(?m)^\s*\d+\.\s*工具名：([A-Za-z0-9_]+)\s*$"), 1)


def render(template: str, **columns: Column) -> Column:
    """A template with {name} placeholders; {{ and }} stand for braces."""
    parts: list[Column] = []
    for literal, name in re.findall(r"((?:\{\{|\}\}|[^{}])+)|\{(\w+)\}", template):
        parts.append(F.lit(literal.replace("{{", "{").replace("}}", "}")) if literal else columns[name].cast("string"))
    return F.concat(*parts)


def render_catalog(tools: Column) -> Column:
    """An array of (tool_name, description, enhanced_description) as numbered blocks with a blank line between."""
    one = lambda t, i: F.concat((i + 1).cast("string"), F.lit(". 工具名："), t["tool_name"], F.lit("\n基本描述："), t["description"], F.lit("\n详细说明："), F.coalesce(t["enhanced_description"], F.lit("")))
    return F.array_join(F.transform(tools, one), "\n\n")


def truthy(*columns: Column) -> Column:
    """The first that is neither null nor empty; the last one, if none is."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns[:-1]], columns[-1])


def binary(c: Column, default: int = 0) -> Column:
    """0 or 1 from a flag written as number or word."""
    word = F.lower(strip(c.cast("string")))
    number = word.try_cast("double")
    return F.when(c.isNull(), default).when(word.isin(*TRUE_WORDS), 1).when(number.isNotNull(), (number >= 1).cast("int")).otherwise(default)


def safe_divide(a: Column, b: Column, empty: float | None = None) -> Column:
    """a / b; where b is 0, ``empty`` (null or 0.0)."""
    return F.coalesce(F.try_divide(a, b), F.lit(empty).cast("double"))


def seeded(seed: int, purpose: str, *key: Column) -> Column:
    """The order in which anything is picked at random: the same on every engine and for every partitioning."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(purpose), *[k.cast("string") for k in key]).cast("binary"))


def words(c: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def segmented(c: Column, dictionary) -> Column:
    """Words of text without spaces: the longest dictionary word at each place, else a run of letters and digits that aren't Han, else one character. ``dictionary`` is a small
    list of words; an alternation that has longer words first is a longest match."""
    listed = "|".join(re.escape(w) for w in sorted(dictionary, key=lambda w: (-len(w), w)))
    return F.regexp_extract_all(F.lower(c), F.lit(rf"({listed + '|' if listed else ''}[\p{{L}}\p{{N}}&&[^\p{{IsHan}}]]+|\p{{IsHan}})"), 1)


def characters(c: Column, n: int = 2) -> Column:
    """Character n-grams, for text without spaces between words."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(c) - (n - 1), F.lit(1))), lambda i: F.substr(c, i, F.lit(n)))


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalise(v: Column) -> Column:
    norm = F.sqrt(inner_product(v, v))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(0.0))
