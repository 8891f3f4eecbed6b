"""Feature records: JSON responses validated, scored and checked for leaks."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import strip
from .masking import YEAR, leak

# The effects and the numeric fields of a record.
EFFECTS = ["supports_risk", "offsets_risk", "supports_pricing_power", "weakens_pricing_power", "supports_protection", "no_policy_support", "uncertain"]
#: JSON name -> (field name, least, most); both names are accepted.
NUMBERS = {"E_sub": ("e_sub", -1, 1), "P_pricing": ("p_pricing", -1, 1), "T_policy": ("t_policy", 0, 1), "confidence": ("confidence", 0, 1)}
ALLOWED = ["candidate_node_alias", "evidence", *NUMBERS, *[f for f, _, _ in NUMBERS.values() if f not in NUMBERS]]
#: A number as text: digits with single underscores between them, a point, an exponent; no suffix, no words.
NUMERIC = r"^\s*[+-]?(?:[0-9]+(?:_[0-9]+)*(?:\.(?:[0-9]+(?:_[0-9]+)*)?)?|\.[0-9]+(?:_[0-9]+)*)(?:[eE][+-]?[0-9]+)?\s*\z"
#: An escape of half a character that the other half doesn't follow, or that follows no first half.
LONE_SURROGATE = r"(?i)(?<!\\)(?:\\\\)*(?:\\ud[89ab][0-9a-f]{2}(?!\\ud[c-f][0-9a-f]{2})|(?<!\\ud[89ab][0-9a-f]{2})\\ud[c-f][0-9a-f]{2})"
STRICT = {"allowSingleQuotes": "false"}
_VARIANTS = ["candidate_node_alias", "evidence", *NUMBERS, *[f for j, (f, _, _) in NUMBERS.items() if f != j]]
TYPED = f"array<struct<{', '.join(f'`{n}`: variant' for n in _VARIANTS)}>>"
#: The same fields under names that differ by more than their case.
PLACED = f"array<struct<{', '.join(f'v{i}: variant' for i in range(len(_VARIANTS)))}>>"


def _field(name: str) -> str:
    return f"v{_VARIANTS.index(name)}"


#: The fixed last part of a prompt record.
INSTRUCTION = "Return the three required numerical features, confidence, and concise structured evidence."


def unfenced(raw: Column) -> Column:
    """The response without white space at its ends and without a code fence; either end of the fence may be missing."""
    text = strip(raw)
    inside = F.regexp_replace(F.regexp_replace(text, r"(?iU)^```(?:json)?\s*", ""), r"(?U)\s*```\z", "")
    return F.when(text.startswith("```"), strip(inside)).otherwise(text)


def assess(responses: DataFrame, raw: str = "raw_json", alias: str = "candidate_node_alias") -> DataFrame:
    """``responses`` with candidate_alias, e_sub, p_pricing, t_policy, confidence, evidence, s_raw and ``reason`` (NULL if valid).

    The response must be one JSON object and nothing else, in JSON's own notation. Of keys that stand twice the last one counts. Values
    keep their types: numbers may be numbers, true and false, or strings that hold a number; texts must be strings. A number has two
    names, of which one may be given. ``alias`` names the column with the candidate that was asked about. ``s_raw = t_policy + p_pricing
    * e_sub`` is only computed here; a supplied one is an extra field.
    """
    # One-element transforms bind what was parsed to a variable: all checks read it, none parses again.
    one = lambda c, f: F.get(F.transform(F.array(c), f), 0)

    def parsed(text: Column) -> Column:
        # What follows the object would end the parse unseen. So the text is parsed as the first of two items of a list; the second holds
        # the text's digest, which the text itself can't forge. Whatever stands behind the object breaks or shifts the list.
        seal = F.sha1(text)
        listed = F.concat(F.lit("["), text, F.lit(', {"'), seal, F.lit('": 0}]'))
        texts = F.transform(F.from_json(listed, "array<map<string,string>>", STRICT), F.map_entries)
        typed = F.get(F.from_json(listed, TYPED, STRICT).cast(PLACED), 0)

        def checked(found: Column) -> Column:
            sealed = (F.size(found) == 2) & (F.get(found, 1)["key"] == F.array(seal))
            return F.when(text.startswith("{") & F.coalesce(sealed, F.lit(False)), F.struct(F.get(found, 0).alias("texts"), typed.alias("m"), text.rlike(LONE_SURROGATE).alias("torn")))

        return one(texts, checked)

    df = responses.withColumn("_r", one(one(F.struct(one(unfenced(F.col(raw)), parsed).alias("r"), F.col(alias).alias("asked")), _typed), _judged))
    fields = ["candidate_alias", *(f for f, _, _ in NUMBERS.values()), "evidence", "reason"]
    df = df.select("*", *[F.col(f"_r.{f}").alias(f) for f in fields]).drop("_r")
    return df.withColumn("s_raw", F.when(F.col("reason").isNull(), F.col("t_policy") + F.col("p_pricing") * F.col("e_sub")))


def _text(value: Column) -> Column:
    """A JSON string; null for values of other types."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _number(value: Column) -> Column:
    """A JSON number, truth value or string that holds a number, as a double; else null."""
    text = F.regexp_replace(F.try_variant_get(value, "$", "string"), "_", "")
    kind = F.schema_of_variant(value)
    words = F.when(F.try_variant_get(value, "$", "string").rlike(NUMERIC), text.try_cast("double"))
    return F.when(kind == "STRING", words).when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("double")).otherwise(F.try_variant_get(value, "$", "double"))


def _typed(x: Column) -> Column:
    """struct(read, keys, torn, who, named, the numbers, items, asked) of struct(r: struct(texts, m, torn), asked)."""
    texts, m = x["r"]["texts"], x["r"]["m"]
    # A value that can't be typed (an object with a key twice) leaves the one before it in place: what is typed must be the last one.
    last = lambda *names: F.try_element_at(F.filter(texts, lambda e: e["key"].isin(*names)), F.lit(-1))["value"]
    number = lambda j, f: F.when(~F.coalesce(last(j, f).rlike(r"^[\[{]"), F.lit(True)), _number(F.coalesce(m[_field(j)], m[_field(f)])))
    who, named = _text(m[_field("candidate_node_alias")]), last("candidate_node_alias")

    def item(entries: Column) -> Column:
        of = lambda key: _text(F.try_element_at(F.filter(entries, lambda e: e["key"] == key), F.lit(-1))["value"])
        return F.struct(entries["key"].alias("keys"), strip(of("observation")).alias("observation"), of("effect").alias("effect"))

    # Items with a key twice can't be typed with the whole; the list is parsed from its own text, unless a string holds that text.
    listed = F.when(~F.coalesce(F.schema_of_variant(m[_field("evidence")]) == "STRING", F.lit(False)) & last("evidence").startswith("["), last("evidence"))
    items = F.transform(F.transform(F.from_json(listed, "array<map<string,variant>>", STRICT), F.map_entries), item)
    read = x["r"].isNotNull() & m.isNotNull()
    return F.struct(read.alias("read"), texts["key"].alias("keys"), x["r"]["torn"].alias("torn"), strip(F.when(who == named, who)).alias("who"), named.alias("named"), *[number(j, f).alias(f) for j, (f, _, _) in NUMBERS.items()], items.alias("items"), x["asked"].alias("asked"))


def _judged(x: Column) -> Column:
    """struct(candidate_alias, numbers, evidence, reason) of what ``_typed`` makes."""
    keys, who, items = x["keys"], x["who"], x["items"]
    out_of_range, twice = F.lit(None).cast("string"), F.lit(False)
    for j, (f, lo, hi) in reversed(NUMBERS.items()):
        # A number that isn't finite fails its bounds like one that is missing.
        out_of_range = F.when(F.coalesce(x[f].between(lo, hi), F.lit(False)), out_of_range).otherwise(F.lit(f))
        twice = twice | (F.array_contains(keys, j) & F.array_contains(keys, f)) if j != f else twice
    fine = F.forall(
        items,
        lambda e: (F.size(F.array_except(e["keys"], F.array(F.lit("observation"), F.lit("effect")))) == 0)
        & F.coalesce(F.length(e["observation"]).between(1, 500), F.lit(False))
        & F.coalesce(e["effect"].isin(*EFFECTS), F.lit(False)),
    )
    reason = (
        F.when(~x["read"], "invalid_json")
        .when((F.size(F.array_except(keys, F.array(*[F.lit(k) for k in ALLOWED]))) > 0) | twice, "extra_field")
        .when(x["torn"], "lone_surrogate")
        .when(who.isNull() & x["named"].isNotNull(), "alias_type")
        .when(~F.coalesce(F.length(who).between(1, 128), F.lit(False)), "alias_length")
        .otherwise(
            F.coalesce(
                F.concat(F.lit("out_of_range:"), out_of_range),
                F.when(~F.coalesce(F.size(items).between(1, 6), F.lit(False)), "evidence_count").when(~F.coalesce(fine, F.lit(False)), "evidence_item").when(who != x["asked"], "wrong_candidate"),
            )
        )
    )
    evidence = F.transform(items, lambda e: F.struct(e["observation"].alias("observation"), e["effect"].alias("effect")))
    return F.struct(who.alias("candidate_alias"), *[x[f].alias(f) for f, _, _ in NUMBERS.values()], evidence.alias("evidence"), reason.alias("reason"))


def alias_reason(alias: Column) -> Column:
    """Why a candidate id must not be used: it names a listing or a year."""
    return F.when(alias.rlike(r"(?i)\.(NS|BO)\b"), "ticker_in_alias").when(alias.rlike(YEAR), "year_in_alias")


def _json(value: Column) -> Column:
    """One value as JSON text; null is ``null``."""
    return F.when(value.isNull(), F.lit("null")).otherwise(F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1))


def prompt(alias: Column, layer: Column, role: Column, masked_text: Column, instruction: str = INSTRUCTION) -> Column:
    """The prompt record as JSON with sorted keys and a space after each colon and comma."""
    candidate = F.concat(F.lit('{"anonymized_id": '), _json(alias), F.lit(', "layer": '), _json(layer), F.lit(', "physical_role": '), _json(role), F.lit("}"))
    return F.concat(F.lit('{"anonymized_source_text": '), _json(masked_text), F.lit(', "candidate": '), candidate, F.lit(', "instruction": '), _json(F.lit(instruction)), F.lit("}"))


#: What a scorer is told beside the prompt record, in this library's words.
SYSTEM = """You read one anonymous node of a physical supply chain and one anonymous source text, and return numbers. You don't pick stocks or forecast returns.

Return one JSON object that fits the schema, and nothing else:
- E_sub, from -1 to 1: how easily the node's inputs can be substituted. -1 is extreme exposure to a shortage, 1 is captive or freely substitutable supply.
- P_pricing, from -1 to 1: pricing power downstream. -1 takes prices, 1 sets them.
- T_policy, from 0 to 1: domestic protection by duties, quality orders, quotas or import limits that the text supports. 0 is none.
- confidence, from 0 to 1, and one to six pieces of evidence, each a short observation from the text with its effect.

Use the text and the role only. Name no companies, tickers, people, years or known events, don't try to lift the masks, and invent no facts. Weak or mixed evidence means values near neutral. Leave S_raw out: it is computed afterwards."""


def response_schema() -> str:
    """The JSON schema of a response, as text with sorted keys, made from the same bounds that ``assess`` checks."""
    text = lambda most, **more: {"type": "string", "minLength": 1, **({"maxLength": most} if most else {}), **more}
    closed = lambda fields: {"type": "object", "properties": fields, "required": sorted(fields), "additionalProperties": False}
    item = closed({"observation": text(500), "effect": {"type": "string", "enum": EFFECTS}})
    numbers = {j: {"type": "number", "minimum": lo, "maximum": hi} for j, (_, lo, hi) in NUMBERS.items()}
    return json.dumps(closed({"candidate_node_alias": text(128), **numbers, "evidence": {"type": "array", "items": item, "minItems": 1, "maxItems": 6}}), sort_keys=True)


def requests(candidates: DataFrame, *, alias: str = "candidate_id", layer: str = "layer", role: str = "physical_role", masked_text: str = "masked_text", system: str = SYSTEM, instruction: str = INSTRUCTION) -> DataFrame:
    """``candidates`` with system_prompt, user_prompt and json_schema, what a model client needs for one call a row."""
    user = prompt(F.col(alias), F.col(layer), F.col(role), F.col(masked_text), instruction)
    return candidates.withColumns({"system_prompt": F.lit(system), "user_prompt": user, "json_schema": F.lit(response_schema())})


def output_leak(raw: Column, originals: Column) -> Column:
    """Leaks in a serialized record; a number such as 0.2019 holds a year and counts as one."""
    return leak(raw, originals)


def stand_in(role: Column) -> Column:
    """struct(e_sub, p_pricing, t_policy, confidence): the deterministic scorer by what the role names."""
    r = F.lower(role)
    of = lambda e, p, t: F.struct(F.lit(e).alias("e_sub"), F.lit(p).alias("p_pricing"), F.lit(t).alias("t_policy"), F.lit(0.8).alias("confidence"))
    return F.when(r.contains("solar glass"), of(-0.8, -0.4, 0.6)).when(r.contains("transformer core"), of(-0.7, -0.3, 0.5)).when(r.contains("fluor"), of(-0.75, -0.2, 0.35)).otherwise(of(-0.35, -0.1, 0.2))


def scored(candidates: DataFrame, role: str = "physical_role") -> DataFrame:
    """``candidates`` with the stand-in's features and ``s_raw``."""
    df = candidates.withColumn("_f", stand_in(F.col(role)))
    return df.withColumn("s_raw", F.col("_f.t_policy") + F.col("_f.p_pricing") * F.col("_f.e_sub")).select("*", "_f.*").drop("_f")
