"""What a model said about a segment, read with tolerance: one struct for each reply, whatever its form.

A reply may be JSON, JSON in a code fence or after thoughts, JSON that was cut off, JSON put as text into the summary of other
JSON, or plain words. Whole JSON is read as VARIANT; of broken JSON only fields between plain delimiters are taken, and words
alone are the summary.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, string_list, strip, unit_interval

# Fields, most characters of each, most items and characters of an item, confidence of a reply that is no JSON.
TEXTS = {"summary": 1200, "ocr_text": 2400, "scene": 240}
LISTS = ("entities", "actions", "uncertainties")
ITEMS = 20
NO_JSON_CONFIDENCE = "0.35"
NO_JSON = "reply is not JSON"

_STRING = r'"([^"\\]*+(?:\\.[^"\\]*+)*+)"'


def bare(reply: Column) -> Column:
    """Without thoughts and the code fence around it."""
    t = strip(F.regexp_replace(reply, "(?s)<think>.*?</think>", ""))
    return F.regexp_replace(F.regexp_replace(t, "^```(?i:json)?\\s*", ""), "\\s*```$", "")


def unescaped(value: Column) -> Column:
    """The text that the inside of a JSON string stands for; of one that is none, with the usual escapes undone."""
    plain = F.replace(F.replace(F.replace(value, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")), F.lit("\\\\"), F.lit("\\"))
    return F.coalesce(F.try_variant_get(F.try_parse_json(F.concat(F.lit('"'), value, F.lit('"'))), "$", "string"), plain)


def _raw(texts: dict[str, Column], lists: dict[str, Column], confidence: Column) -> Column:
    return F.struct(*(texts[k].alias(k) for k in TEXTS), *(lists[k].alias(k) for k in LISTS), confidence.alias("confidence"))


def _from_variant(value: Column) -> Column:
    get = lambda name: F.try_variant_get(value, f"$.{name}", "string")
    items = lambda name: F.coalesce(F.try_variant_get(value, f"$.{name}", "array<string>"), F.when(get(name).isNotNull(), F.array(get(name))))
    return _raw({k: get(k) for k in TEXTS}, {k: items(k) for k in LISTS}, get("confidence"))


def _salvaged(text: Column) -> Column:
    """Fields of broken JSON that stand between plain delimiters, null where there are none."""
    found = lambda pattern: F.when(F.regexp_like(text, F.lit(pattern)), F.regexp_extract(text, pattern, 1))
    value = lambda name: unescaped(found(f'(?s)"{name}"\\s*:\\s*{_STRING}'))
    items = lambda name: F.transform(F.regexp_extract_all(found(f'(?s)"{name}"\\s*:\\s*\\[(.*?)\\]'), F.lit(f"(?s){_STRING}"), F.lit(1)), unescaped)
    return _raw({k: value(k) for k in TEXTS}, {k: items(k) for k in LISTS}, found('"confidence"\\s*:\\s*([0-9]+(?:\\.[0-9]+)?)'))


def _merged(raw: Column) -> Column:
    """raw, or the JSON that its summary is, where its own fields say something; the confidence of a reply that was no JSON says nothing."""
    says = {k: F.coalesce(raw[k], F.lit("")) != "" for k in ("ocr_text", "scene")} | {k: F.size(raw[k]) > 0 for k in LISTS}

    def of(inner: Column) -> Column:
        pick = lambda k: F.when(F.coalesce(says[k], F.lit(False)), raw[k]).otherwise(inner[k])
        told = F.when((F.coalesce(raw["confidence"], F.lit("")) != "") & (unit_interval(raw["confidence"]) != float(NO_JSON_CONFIDENCE)), raw["confidence"]).otherwise(inner["confidence"])
        both = _raw({"summary": inner["summary"]} | {k: pick(k) for k in ("ocr_text", "scene")}, {k: pick(k) for k in LISTS}, told)
        return F.when(F.coalesce(strip(raw["summary"]), F.lit("")).startswith("{") & (F.coalesce(inner["summary"], F.lit("")) != ""), both).otherwise(raw)

    return let(_salvaged(strip(raw["summary"])), of)


def normalise(reply: Column) -> Column:
    """(summary, ocr_text, scene, entities, actions, uncertainties, confidence) of a reply; null for one that is null or empty.

    Texts are trimmed and cut to their length, items trimmed, without empty and repeated ones, at most 20 of 160 characters; a
    value that is no list is a list of one. A confidence is kept between 0 and 1 and is 0 where it is no number."""

    def read(t: Column) -> Column:
        body = F.when((F.instr(t, "{") > 0) & (F.instr(t, "}") > 0), F.regexp_extract(t, "(?s)(\\{.*\\})", 1))
        none = F.lit(None).cast("string")
        words = _raw({"summary": F.substring(t, 1, TEXTS["summary"]), "ocr_text": none, "scene": none}, {k: F.array(F.lit(NO_JSON)) if k == "uncertainties" else F.lit(None).cast("array<string>") for k in LISTS}, F.lit(NO_JSON_CONFIDENCE))
        whole = lambda v: F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), _from_variant(v)).otherwise(words)
        raw = let(F.try_parse_json(body), whole)
        done = lambda r: F.struct(*(F.substring(strip(F.coalesce(r[k], F.lit(""))), 1, n).alias(k) for k, n in TEXTS.items()), *(string_list(r[k], ITEMS).alias(k) for k in LISTS), unit_interval(r["confidence"]).alias("confidence"))
        return F.when(t != "", let(let(raw, _merged), done))

    return let(bare(reply), read)


def told(reply: Column) -> Column:
    """The text by which a segment is found: what normalise() says of summary, scene, entities and actions."""
    # Marks before the parts.
    parts = (reply["summary"], _marked("场景：", reply["scene"]), _marked("人物与物体：", F.array_join(reply["entities"], "、")), _marked("动作与变化：", F.array_join(reply["actions"], "、")))
    return F.concat_ws(" ", *(F.when(p != "", p) for p in parts))


def structured(reply: Column) -> Column:
    """All that a reply says in fields, for the evidence gate; null if it says nothing."""
    text = F.concat_ws(" ", *(F.when(reply[k] != "", reply[k]) for k in ("summary", "ocr_text", "scene")), F.array_join(reply["entities"], " "), F.array_join(reply["actions"], " "))
    return F.when(strip(text) != "", text)


def _marked(mark: str, value: Column) -> Column:
    return F.when(value != "", F.concat(F.lit(mark), value))
