"""Text functions as Spark SQL expressions: tokens, keywords, sentences, time references, claims."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and phrases of questions that carry no content of their own.
GENERIC_TEXT = "这个 视频 主要 内容 总结 请 给出 时间戳 证据 回答 问题 哪里 哪段 是否 有没有 出现 明确 直接 对应 位置 讲了 讲到 说明 指出 列出 每一步 什么 怎么样"
GENERIC_PHRASES = ["这个视频", "视频中", "视频里", "请分别给出时间戳", "请给出带时间戳的证据", "请给出时间戳", "哪里展示了", "哪里讲到了", "有没有提到"]
# Units of claims that say nothing, and marks of refusals.
GENERIC_UNITS = ["视频", "画面", "展示", "可以", "看到", "出现", "片段", "证据", "结论", "随后", "进行", "一个", "一名", "男子", "女子", "镜头", "时间"]
REFUSALS_OF_CLAIMS = ["证据不足", "无法确认", "不能确认", "无法回答", "不足以支持", "未提供足以支持", "未提供足够证据"]
REFUSALS = ["证据不足", "无法确认", "不能确认", "无法回答", "不足以支持", "未提供足够证据"]


def _quoted(words: list[str]) -> Column:
    return F.array(*(F.lit(w) for w in words)) if words else F.array().cast("array<string>")


def let(value: Column, body) -> Column:
    """body(value), with value worked out once a row."""
    return F.transform(F.array(value), body)[0]


def bigrams(word: Column) -> Column:
    """All two-character pieces of a longer word, or the word."""
    return F.when(F.length(word) <= 2, F.array(word)).otherwise(F.transform(F.sequence(F.lit(1), F.length(word) - 1), lambda i: F.substring(word, i, F.lit(2))))


def tokens(text: Column) -> Column:
    """Lower-case Latin words of two letters or more, and runs of Han characters, in pairs where longer; null for null."""
    # Without a Han character the words are the matches of one pattern; only other texts go through the pieces one by one.
    plain = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{2,}"), F.lit(0))
    found = F.regexp_extract_all(F.lower(text), F.lit("([a-zA-Z0-9]+|[一-鿿]+)"), F.lit(1))
    pieces = F.flatten(F.transform(found, lambda t: F.when(t.rlike("^[一-鿿]+$"), bigrams(t)).when(F.length(t) > 1, F.array(t)).otherwise(F.array().cast("array<string>"))))
    return F.when(text.rlike("[一-鿿]"), pieces).otherwise(plain)


def keywords(text: Column) -> Column:
    return F.array_distinct(tokens(F.coalesce(text, F.lit(""))))


def plain_tokens(text: str) -> list[str]:
    """tokens() of a constant, for parameters."""
    out = []
    for t in re.findall("[a-z0-9]+|[一-鿿]+", text.lower()):
        if "一" <= t[0] <= "鿿":
            out += [t] if len(t) <= 2 else [t[i : i + 2] for i in range(len(t) - 1)]
        elif len(t) > 1:
            out.append(t)
    return out


GENERIC_TERMS = list(dict.fromkeys(plain_tokens(GENERIC_TEXT)))


def informative(text: Column) -> Column:
    """Keywords left without generic phrases and terms."""
    cleaned = F.lower(F.coalesce(text, F.lit("")))
    for phrase in GENERIC_PHRASES:
        cleaned = F.replace(cleaned, F.lit(phrase), F.lit(" "))
    return F.array_except(keywords(cleaned), _quoted(GENERIC_TERMS))


def overlap(terms: Column, others: Column) -> Column:
    """Share of terms found among others; 0 without terms."""
    return F.when(F.size(terms) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(terms, others)) / F.greatest(F.size(terms), F.lit(1)).cast("double"))


def sentences(text: Column) -> Column:
    """Pieces that end with a stop or a line, trimmed, without empty ones."""
    parts = F.split(F.coalesce(text, F.lit("")), "(?<=[。！？.!?])\\s*|[\\n\\r]+")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, "^[\\s\\u00a0\\u3000]+|[\\s\\u00a0\\u3000]+$", "")


def searchable(*channels: Column) -> Column:
    """The channels that say something, trimmed and joined."""
    return F.concat_ws(" ", *(F.nullif(strip(c), F.lit("")) for c in channels))


# Fixed value: how an answer names a time; evidence tags, bindings and claims depend on it.
TIMESTAMP = "timestamp=([0-9]+(?:\\.[0-9]+)?-[0-9]+(?:\\.[0-9]+)?)"


def time_references(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TIMESTAMP), F.lit(1))


def time_key(reference: Column) -> Column:
    """(start, end) of "a-b", to a thousandth; null fields where there is none."""
    m = lambda i: F.regexp_extract(reference, "([0-9]+(?:\\.[0-9]+)?)-([0-9]+(?:\\.[0-9]+)?)", i)
    return F.struct(F.bround(m(1).try_cast("double"), 3).alias("start"), F.bround(m(2).try_cast("double"), 3).alias("end"))


def loose_time_key(text: Column) -> Column:
    """As time_key, with optional spaces and seconds marks, as answers write it."""
    p = "([0-9]+(?:\\.[0-9]+)?)\\s*s?\\s*[-–—]\\s*([0-9]+(?:\\.[0-9]+)?)\\s*s?"
    return F.struct(F.bround(F.regexp_extract(text, p, 1).try_cast("double"), 3).alias("start"), F.bround(F.regexp_extract(text, p, 2).try_cast("double"), 3).alias("end"))


def time_ranges(text: Column) -> Column:
    """Distinct ranges "a-b" (any dash) with b > a, in order."""
    p = F.lit("([0-9]+(?:\\.[0-9]+)?)\\s*[-–—]\\s*([0-9]+(?:\\.[0-9]+)?)")
    both = F.arrays_zip(F.regexp_extract_all(text, p, F.lit(1)).alias("a"), F.regexp_extract_all(text, p, F.lit(2)).alias("b"))
    spans = F.transform(both, lambda x: F.struct(x["a"].cast("double").alias("start"), x["b"].cast("double").alias("end")))
    return F.array_distinct(F.filter(spans, lambda s: s["end"] > s["start"]))


def tenth(x: Column) -> Column:
    """Rounded half up to a tenth, as text with one decimal."""
    return F.format_string("%.1f", F.floor(x * 10 + 0.5) / 10)


def evidence_tag(start: Column, end: Column) -> Column:
    return F.concat(F.lit("timestamp="), tenth(start), F.lit("-"), tenth(end))


def clock(text: Column) -> Column:
    """Seconds of "HH:MM:SS,mmm", "MM:SS" or "SS"; null where it is none of them."""
    parts = F.split(F.replace(F.trim(text), F.lit(","), F.lit(".")), ":")
    n = lambda i: F.try_element_at(parts, F.lit(i)).try_cast("double")
    return F.when(F.size(parts) == 3, n(1) * 3600 + n(2) * 60 + n(3)).when(F.size(parts) == 2, n(1) * 60 + n(2)).when(F.size(parts) == 1, n(1))


def contains_any(text: Column, marks: list[str]) -> Column:
    return F.exists(_quoted(marks), lambda m: F.contains(text, m))


def is_refusal(answer: Column, marks: list[str] = REFUSALS) -> Column:
    return contains_any(F.coalesce(answer, F.lit("")), marks)


def has_structure(answer: Column) -> Column:
    """Whether an answer names its question and its conclusion, or is a trace of steps."""
    low = F.lower(answer)
    has = lambda t, *marks: F.expr("true") if not marks else _all(t, marks)
    return has(low, "retrieve:", "synthesize:") | has(answer, "问题：", "结论：") | has(answer, "用户问题：", "总体结论：") | has(low, "question:", "answer:")


def _all(text: Column, marks) -> Column:
    out = F.contains(text, F.lit(marks[0]))
    for m in marks[1:]:
        out &= F.contains(text, F.lit(m))
    return out


def normal(text: Column) -> Column:
    """Only letters, digits and Han characters, in lower case."""
    return F.lower(F.regexp_replace(text, "[^㐀-鿿a-zA-Z0-9]+", ""))


def spaced(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, "\\s+", " ")))


def identifier(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def units(text: Column) -> Column:
    """Distinct units of meaning of a claim: Latin words and pairs of Han characters, but for generic ones."""
    latin = F.transform(F.regexp_extract_all(text, F.lit("([a-zA-Z][a-zA-Z0-9_-]+)"), F.lit(1)), F.lower)
    han = F.filter(F.regexp_extract_all(text, F.lit("([㐀-鿿]+)"), F.lit(1)), lambda t: F.length(t) > 1)
    return F.array_except(F.array_distinct(F.concat(latin, F.flatten(F.transform(han, bigrams)))), _quoted(GENERIC_UNITS))


def claim_line(line: Column) -> Column:
    """A line without its time reference, bullet, leading range and label."""
    # Bullets, ranges and labels as answers are written; which claims there are depends on them.
    out = F.regexp_replace(line, TIMESTAMP, "")
    out = F.regexp_replace(out, "\\(\\s*\\)", "")
    out = F.regexp_replace(out, "^\\s*[-*]\\s*", "")
    out = F.regexp_replace(out, "^[0-9]+(?:\\.[0-9]+)?\\s*[-–—]\\s*[0-9]+(?:\\.[0-9]+)?\\s*[：:]?", "")
    out = F.regexp_replace(out, "^(问题|结论|总体结论|证据)\\s*[：:]", "")
    return F.regexp_replace(out, "^[ ：:。.;；]+|[ ：:。.;；]+$", "")


def clauses(line: Column) -> Column:
    """Clauses of a cleaned line with four characters or more."""
    # Marks between clauses, the least length, and headings that claim nothing.
    parts = F.transform(F.split(line, "[，,；;。]+"), lambda c: F.regexp_replace(c, "^[ \\-：:。.;；]+|[ \\-：:。.;；]+$", ""))
    return F.filter(parts, lambda c: (F.length(F.regexp_replace(c, "\\s+", "")) >= 4) & ~c.isin("时间戳证据", "候选证据"))


def support(claim: Column, evidence: Column) -> Column:
    """1 where the evidence holds the claim word for word, else the share of its units found there."""
    a, b = normal(claim), normal(evidence)
    share = let(F.struct(units(claim).alias("c"), units(evidence).alias("e")), lambda u: overlap(u["c"], u["e"]))
    return F.when((F.length(a) >= 4) & F.contains(b, a), F.lit(1.0)).otherwise(share)


def string_list(values: Column, cap: int = 24) -> Column:
    """Trimmed, not empty, distinct in order, at most 160 characters each, at most cap."""
    clean = F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), strip), lambda s: s.isNotNull() & (s != ""))
    return F.slice(F.transform(F.array_distinct(clean), lambda s: F.substring(s, 1, 160)), 1, cap)


def unit_interval(value: Column) -> Column:
    """A number in text or numeric form, kept between 0 and 1; 0 if it is none."""
    x = value.cast("string").try_cast("double")
    return F.coalesce(F.when(F.isnan(x), None).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))), F.lit(0.0))


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.to_json(F.array(*(p.cast("string") for p in parts))), 256)


def model_json(text: Column, schema: str) -> Column:
    """A struct from a model's reply: without thoughts and code fences, from the first brace to the last; null if it isn't JSON."""
    t = F.regexp_replace(text, "(?s)<think>.*?</think>", "")
    t = F.regexp_replace(t, "```(?:json)?", "")
    return F.from_json(F.regexp_extract(t, "(?s)(\\{.*\\})", 1), schema)


def answer_fields(answer: Column) -> Column:
    """The question and conclusion lines of an answer."""
    q = F.regexp_extract(answer, "(?m)^\\s*(?:用户问题|问题)：(.*)$", 1)
    c = F.regexp_extract(answer, "(?m)^\\s*(?:总体结论|结论)：(.*)$", 1)
    return F.struct(F.trim(q).alias("question"), F.trim(c).alias("conclusion"))


def plain(text: Column) -> Column:
    """Without emphasis, code and heading marks."""
    return strip(F.regexp_replace(F.regexp_replace(text, "[*_`]{1,3}", ""), "(?m)^#+\\s*", ""))
