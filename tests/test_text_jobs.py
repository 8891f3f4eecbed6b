"""Dates, events, routing, masking, features, pages, readers and writers."""

import datetime as dt
import json
import time

import pytest
from pyspark.sql import functions as F

from tideline.functions.dates import extract_date, field_date
from tideline.functions.quality import Invalid
from tideline.operators import events, features, masking, routing
from tideline.plans import seed
from tideline.sources import html, sinks, tables
from tideline.streaming.events import first_of_each

D = dt.date


@pytest.mark.parametrize(
    ("text", "found", "iso"),
    [
        ("on 04/03/2024 it", D(2024, 3, 4), D(2024, 3, 4)),
        ("12/31/2024", D(2024, 12, 31), D(2024, 12, 31)),
        ("3 Sept 2024", D(2024, 9, 3), D(2024, 9, 3)),
        ("3 marching 2024 or 4 March 2024", None, None),
        ("2024-03-04", D(2024, 4, 3), D(2024, 3, 4)),
        ("2024-13-01", D(2024, 1, 13), None),
        ("99/99/2024", None, None),
        ("99/99/2024 or 5 MAY 2024", D(2024, 5, 5), D(2024, 5, 5)),
        ("30-02-2024", None, None),
        ("1/1/1850", None, None),
        (None, None, None),
    ],
)
def test_dates(spark, text, found, iso):
    df = spark.createDataFrame([(text,)], "t string")
    assert tuple(df.select(extract_date(F.col("t")), extract_date(F.col("t"), iso_dayfirst=False)).first()) == (found, iso)


FIELDS = [
    ("2024-03-04T10:11:12", D(2024, 4, 3)), ("2024-03-04 10:11:12.123", D(2024, 4, 3)), ("2024-03-04T10:11:12Z", D(2024, 4, 3)), ("2024-03-04T10:11:12+05:30", D(2024, 4, 3)),
    ("04/03/2024T10:11", D(2024, 3, 4)), ("04/03/2024, 10:11", D(2024, 3, 4)), ("04/03/2024 10:11:12 PM", D(2024, 3, 4)), ("04.03.2024", D(2024, 3, 4)), ("04 03 2024", D(2024, 3, 4)),
    ("2024/03/04", D(2024, 4, 3)), ("2024.03.04", D(2024, 4, 3)), ("2024-13-01", D(2024, 1, 13)), ("12/31/2024", D(2024, 12, 31)), ("13/25/2024", None), ("31/04/2024", None), ("99/99/2024", None),
    ("March 4, 2024", D(2024, 3, 4)), ("Mar 4 2024", D(2024, 3, 4)), ("Mar-04-2024", D(2024, 3, 4)), ("4th March 2024", D(2024, 3, 4)), ("04-Mar-2024", D(2024, 3, 4)), ("4Mar2024", D(2024, 3, 4)), ("4-Mar-24", D(2024, 3, 4)),
    ("4 Sept 2024", D(2024, 9, 4)), ("2024 March 4", D(2024, 3, 4)), ("2024-Mar-04", D(2024, 3, 4)), ("Monday, 4 March 2024", D(2024, 3, 4)), ("20240304", D(2024, 3, 4)), ("20240304T101112", D(2024, 3, 4)),
    ("04/03/24", D(2024, 3, 4)), (" 04/03/2024\n", D(2024, 3, 4)), ("4/3/1850", D(1850, 3, 4)), ("March 2024", D(2024, 3, 1)), ("2024-03", D(2024, 3, 1)), ("", None), ("nan", None), ("Order of 04/03/2024.", None), (None, None),
]


def test_date_fields_as_pandas_reads_them(spark):
    import pandas as pd

    got = {r.t: r.d for r in spark.createDataFrame([(t,) for t, _ in FIELDS], "t string").select("t", field_date(F.col("t")).alias("d")).collect()}
    assert got == dict(FIELDS)
    for text, day in FIELDS:
        found = pd.to_datetime(text, dayfirst=True, errors="coerce")
        assert (None if pd.isna(found) else found.date()) == day, text
    true_iso = spark.createDataFrame([("2024-03-04T10:11",)], "t string").select(field_date(F.col("t"), iso_dayfirst=False)).first()[0]
    assert true_iso == D(2024, 3, 4)


def raw_event(spark, rows):
    df = spark.createDataFrame(rows, "source string, day date, title string, url string, text string, node string, at timestamp")
    meta = F.when(F.col("node").isNotNull(), F.create_map(F.lit("candidate_node"), F.col("node")))
    return events.make_events(df, source=F.col("source"), event_type=F.lit("t"), published_date=F.col("day"), title=F.col("title"), url=F.col("url"), text=F.col("text"), metadata=meta, fetched_at=F.col("at"))


T0 = dt.datetime(2024, 1, 2)


def test_event_ids_and_last_wins(spark):
    import hashlib

    a = raw_event(spark, [("A", D(2024, 1, 1), " One \t Two\n", "u", " old ", None, T0)])
    b = raw_event(spark, [("A", D(2024, 1, 1), "one two", "u", "new", None, T0), ("B", D(2024, 1, 1), "x", "u", "", None, T0)])
    rows = events.ordered(events.merged([a, b])).collect()
    assert [(r.source, r.text) for r in rows] == [("A", "new"), ("B", "")]
    assert rows[0].event_id == hashlib.sha256(b"A|t|2024-01-01|one two|u").hexdigest()
    got, status = events.collected(spark, {"good": lambda: a, "bad": lambda: 1 / 0}, lambda df, name: df)
    assert got.count() == 1 and {(r.source, r.n_events, r.error is None) for r in status.collect()} == {("good", 1, True), ("bad", 0, False)}


def test_window_and_keywords(spark):
    e = raw_event(spark, [("A", D(2024, 1, d), "x", str(d), "", None, T0) for d in range(1, 12)])
    start, end = events.window_of(F.to_date(F.lit("2024-01-10")))
    assert sorted(r.published_date.day for r in events.in_window(e, start, end).collect()) == [4, 5, 6, 7, 8, 9, 10]
    words = spark.createDataFrame([("Anti-Dumping duty",), ("trade remedy",), ("a safeguard",), ("safeguards",)], "t string")
    assert [r[0] for r in words.select(events.keyword_match(F.col("t"), events.TRADE_REMEDY)).collect()] == [True, False, True, False]
    with pytest.raises(ValueError):
        events.window_of(F.current_date(), 0)


def test_quality_orders(spark):
    t = spark.createDataFrame([("Bolts", "01/02/2024", "M"), ("nan", "01/02/2024", "M"), ("Nuts", "someday", "M"), ("Pins", "01/07/2024", None), ("Late", "01/12/2024", "M")], "`Product name` string, `Date of Implementation` string, Ministry string")
    out = {r.metadata["product"]: (r.published_date, r.text) for r in events.quality_orders(t, F.to_date(F.lit("2024-01-28")), F.to_date(F.lit("2024-02-03")), "u").collect()}
    assert out["Bolts"] == (D(2024, 2, 1), "Product: Bolts. Enforcement date: 2024-02-01. Ministry/Department: M. Indian Standard: .")
    assert set(out) == {"Bolts", "Pins"} and out["Pins"][0] == D(2024, 2, 3)
    assert events.quality_orders(spark.createDataFrame([("x",)], "a string"), F.current_date(), F.current_date(), "u").count() == 0


def test_announcements(spark):
    rows = [{"NEWSSUB": "", "HEADLINE": " Head ", "DissemDT": "2024-01-13T09:08:07.65", "ATTACHMENTNAME": "f.pdf", "SLONGNAME": "Firm", "SCRIP_CD": 5}, {"NEWS_SUB": "Sub", "NEWS_DT": "01/01/2024", "ATTACHMENTNAME": "http://h/x"}, {"NEWSSUB": "No date"}, {"NEWS_DT": "01/01/2024"}, "odd", {"NEWSSUB": " ", "HEADLINE": "hidden", "NEWS_DT": "01/01/2024"}]
    df = tables.announcement_rows(spark.createDataFrame([(json.dumps({"Table": rows}),), ("{}",), ("broken",)], "value string"))
    docs = spark.createDataFrame([("base/f.pdf", "body")], "url string, text string")
    out = {r.title: r for r in events.announcements(df, F.to_date(F.lit("2024-01-01")), F.to_date(F.lit("2024-01-31")), attachment_base="base/", default_url="d", documents=docs).collect()}
    assert set(out) == {"Head", "Sub"}
    assert (out["Head"].url, out["Head"].text, out["Head"].metadata["company_name"], out["Head"].metadata["scrip_code"]) == ("base/f.pdf", "body", "Firm", "5")
    assert (out["Sub"].url, out["Sub"].text) == ("http://h/x", "Sub")


def test_routing_and_documents(spark):
    rows = [
        ("A", D(2024, 1, 2), "Solar glass and CRGO", "1", "x", None, T0),
        ("A", D(2024, 1, 1), "solar glass", "2", "y", None, T0),
        ("A", D(2024, 1, 1), "fluorspars", "3", "", "RAW_CRUDE", T0),
        ("A", D(2024, 1, 1), "nothing", "4", "", "SRF.NS", T0),
        ("A", D(2024, 1, 1), "nothing", "5", "", "UNKNOWN", T0),
        ("A", D(2024, 1, 1), "ahfx", "6", "", "", T0),
    ]
    routed = routing.route(raw_event(spark, rows), seed.nodes(spark))
    got = {}
    for r in routed.collect():
        got.setdefault(r.node_id, set()).add(r.url)
    assert got == {"COMP_SOLAR_GLASS": {"1", "2"}, "COMP_TRANSFORMER_CORES": {"1"}, "COMP_FLUOROCHEMICAL_FEED": {"3"}, "RAW_CRUDE": {"3"}}
    named = routed.withColumn("metadata", F.create_map(F.lit("company_name"), F.concat(F.lit("Co"), F.col("source"))))
    docs = {r.node_id: r for r in routing.documents(named, max_chars=60).collect()}
    glass = docs["COMP_SOLAR_GLASS"]
    full = "Source: A\nDate: 2024-01-01\nTitle: solar glass\nText: y\n\n---\n\nSource: A\nDate: 2024-01-02\nTitle: Solar glass and CRGO\nText: x"
    assert glass.source_text == full[:60] and glass.n_events == 2 and glass.company_aliases == {"CoA": "Issuer_002"}
    assert {r.node_id: r.candidate_id for r in routing.aliases(routed).collect()}["COMP_FLUOROCHEMICAL_FEED"] == "Candidate_001"


def test_masking(spark):
    text = "Borosil Renewables and BORORENEW.NS met Jane Doe in 2022 after COVID-19 of 2020; SRFX and x12020, 2020-2021 éSRF."
    df = spark.createDataFrame([(1, text, ["Jane Doe", " "], {"Acme": "Own_1"}), (2, "  ", [], {}), (3, "acme & SRF", None, {"Acme": "Own_1"})], "id int, text string, people array<string>, own map<string,string>")
    out = {r.id: r["mask"] for r in masking.mask(df, executives="people", companies="own").collect()}
    assert out[1].masked_text == "Supplier_K and Equity_C met Executive_A in T_2 after Macro_Disruption_Alpha of T_0; SRFX and x12020, T_0-T_1 éSRF."
    assert out[2].reason == "blank_text" and out[3].masked_text == "Own_1 & Supplier_F"
    assert [r.category for r in out[3].redactions] == ["company", "company"]
    masked = masking.mask(spark.createDataFrame([(1, "SRF near SRFX"), (2, "SRF")], "id int, text string"))
    assert {(r.id, r.leak_literal) for r in masking.leaks(masked, "id").collect()} == {(1, "SRF")}
    assert masking.redaction_log(masked, "id").count() == 2
    places = spark.createDataFrame([(25,), (26,)], "i int").select(masking.executive_alias(F.col("i")).alias("a"))
    assert [r.a for r in places.collect()] == ["Executive_Z", "Executive_27"]
    odd = spark.createDataFrame([(1, "x", {" ": "y"}), (2, "a.b $1 (c) \\E a\u00dfb", {"a.b": "$0\\", "(c)": "C", "\\E": "Q", "$1": "D"})], "id int, text string, own map<string,string>")
    got = {r.id: r["mask"] for r in masking.mask(odd, companies="own", defaults=False).collect()}
    assert got[1].reason == "blank_rule" and got[1].masked_text is None and got[2].masked_text == "$0\\ D C Q a\u00dfb"
    years = spark.createDataFrame([("2021, 1999 and 2021; 20210",)], "t string").select(masking.masked_years(F.col("t"))).first()[0]
    assert years == "T_1, T_0 and T_1; 20210"


def test_masking_looks_literals_up_whatever_their_case(spark):
    """The look-up before a rule's pattern loses no match: whatever the pattern takes for one letter has one form there."""
    chars = [chr(c) for c in range(0x20, 0x10000) if not 0xD800 <= c < 0xE000 and chr(c).lower() + chr(c).upper() != chr(c) * 2]
    pairs = {(c, d) for c in chars for x in (c.lower(), c.upper(), c.upper().lower(), c.lower().upper(), c.casefold()) if len(x) == 1 for d in (x,)}
    pairs |= {(c, d) for c in "iI\u0130\u0131sS\u017fkK\u212a\u00e5\u212b\u00df\u1e9e\u03c3\u03c2\u03a3" for d in "iI\u0130\u0131sS\u017fkK\u212a\u00e5\u212b\u00df\u1e9e\u03c3\u03c2\u03a3"}
    df = spark.createDataFrame(sorted(pairs), "a string, b string")
    lost = df.where(F.rlike("b", F.concat(F.lit(r"(?iU)\Q"), "a", F.lit(r"\E"))) & (masking.needle(F.col("a")) != masking.needle(F.col("b"))))
    assert df.count() > 2000 and lost.collect() == []
    rules = {"Straße AG": "S_1", "Inc": "S_2", "S_1 of": "S_3", "ΟΔΟΣ": "S_4", "a.b": "S_5"}
    texts = ["STRAẞE AG of İnc; Inca ıNC", "οδος.Α ΟΔΟΣ.ΑΒ οδοσ", "axb A.B", ""]
    docs = spark.createDataFrame([(t, rules) for t in texts], "text string, own map<string,string>")
    got = [r.m.masked_text for r in masking.mask(docs, companies="own", defaults=False).selectExpr("mask AS m").collect()]
    assert got == ["S_3 S_2; Inca S_2", "S_4.Α S_4.ΑΒ S_4", "axb S_5", None]


GOOD = {"candidate_node_alias": "C1", "E_sub": -0.8, "P_pricing": 0.5, "T_policy": 0.4, "confidence": 0.82, "evidence": [{"observation": "seen", "effect": "uncertain"}] * 3}


@pytest.mark.parametrize(
    ("change", "reason"),
    [
        ({}, None),
        ({"E_sub": "-0.8"}, None),
        ({"E_sub": 1.0001}, "out_of_range:e_sub"),
        ({"E_sub": -1.0001}, "out_of_range:e_sub"),
        ({"P_pricing": 1.5}, "out_of_range:p_pricing"),
        ({"T_policy": -0.01}, "out_of_range:t_policy"),
        ({"T_policy": 1.01}, "out_of_range:t_policy"),
        ({"confidence": None}, "out_of_range:confidence"),
        ({"E_sub": float("nan")}, "out_of_range:e_sub"),
        ({"S_raw": 0.1}, "extra_field"),
        ({"candidate_node_alias": "C2"}, "wrong_candidate"),
        ({"candidate_node_alias": " "}, "alias_length"),
        ({"evidence": []}, "evidence_count"),
        ({"evidence": GOOD["evidence"] * 3}, "evidence_count"),
        ({"evidence": [{"observation": "", "effect": "uncertain"}]}, "evidence_item"),
        ({"evidence": [{"observation": "x", "effect": "odd"}]}, "evidence_item"),
        ({"evidence": [{"observation": "x", "effect": "uncertain", "more": 1}]}, "evidence_item"),
    ],
)
def test_feature_records(spark, change, reason):
    raw = json.dumps(GOOD | change)
    texts = [raw, f"```json\n{raw}\n```", f"\n\t{raw}\n", f"\n```\n{raw}\n```\n", f"```JSON {raw}```", f"```json\n{raw}", f"{raw}"]
    for r in features.assess(spark.createDataFrame([("C1", t) for t in texts], "candidate_node_alias string, raw_json string")).collect():
        assert r.reason == reason
        assert r.s_raw == (None if reason else pytest.approx(0.0, abs=1e-12))


def test_more_feature_checks(spark):
    df = spark.createDataFrame([("C1", "{"), ("C1", "[1]"), ("C1", None)], "candidate_node_alias string, raw_json string")
    assert {r.reason for r in features.assess(df).collect()} == {"invalid_json"}
    a = spark.createDataFrame([("BORORENEW.NS",), ("Supplier_2020",), ("Supplier_12020",)], "a string")
    assert [r[0] for r in a.select(features.alias_reason(F.col("a"))).collect()] == ["ticker_in_alias", "year_in_alias", None]
    roles = spark.createDataFrame([("Solar Glass x",), ("transformer cores",), ("fluor",), ("z",)], "physical_role string")
    assert [round(r.s_raw, 6) for r in features.scored(roles).collect()] == [0.92, 0.71, 0.5, 0.235]


BODY = json.dumps(GOOD)


NOTATIONS = [
    (BODY + " and more", "invalid_json"),
    (BODY + BODY, "invalid_json"),
    (f"{BODY},{BODY}", "invalid_json"),
    (BODY + "]", "invalid_json"),
    (BODY + "] }", "invalid_json"),
    (BODY + ', {"x": 0}', "invalid_json"),
    (f"[{BODY}]", "invalid_json"),
    (BODY.replace('"', "'"), "invalid_json"),
    (BODY[:-1] + ",}", "invalid_json"),
    (BODY.replace('"P_pricing": ', '"P_pricing": 0'), "invalid_json"),
    (BODY.replace('"P_pricing": ', '"P_pricing": +'), "invalid_json"),
    (BODY[:-1] + ', "P_pricing": 0.8d}', "invalid_json"),
    (BODY[:-1] + ', "P_pricing": "0.8d"}', "out_of_range:p_pricing"),
    (BODY[:-1] + ', "P_pricing": "0.8f"}', "out_of_range:p_pricing"),
    (BODY[:-1] + ', "P_pricing": "0x1p-1"}', "out_of_range:p_pricing"),
    (BODY[:-1] + ', "P_pricing": "nan"}', "out_of_range:p_pricing"),
    (BODY[:-1] + ', "P_pricing": "1__0e-2"}', "out_of_range:p_pricing"),
    (BODY[:-1] + ', "P_pricing": Infinity}', "out_of_range:p_pricing"),
    (BODY[:-1] + ', "P_pricing": 1e999}', "out_of_range:p_pricing"),
    (BODY[:-1] + ', "P_pricing": {"a": 1, "a": 2}}', "out_of_range:p_pricing"),
    (BODY[:-1] + ', "candidate_node_alias": 17}', "alias_type"),
    (BODY[:-1] + ', "candidate_node_alias": null}', "alias_length"),
    (BODY[:-1] + ', "candidate_node_alias": true}', "alias_type"),
    (BODY[:-1] + ', "evidence": {"observation": "x", "effect": "uncertain"}}', "evidence_count"),
    (BODY[:-1] + ', "evidence": [17]}', "evidence_count"),
    (BODY[:-1] + ', "evidence": [{"observation": 17, "effect": "uncertain"}]}', "evidence_item"),
    (BODY[:-1] + ', "evidence": [{"observation": "x", "effect": "uncertain "}]}', "evidence_item"),
    (BODY[:-1] + ', "evidence": [{"observation": "x"}]}', "evidence_item"),
    (BODY[:-1] + ', "evidence": [{"observation": "\\ud800", "effect": "uncertain"}]}', "lone_surrogate"),
    (BODY[:-1] + ', "evidence": [{"observation": "\\udc00x", "effect": "uncertain"}]}', "lone_surrogate"),
    (BODY[:-1] + ', "evidence": "[{\\"observation\\": \\"x\\", \\"effect\\": \\"uncertain\\"}]"}', "evidence_count"),
    (BODY[:-1] + ', "e_sub": 0.5}', "extra_field"),
    (BODY[:-1] + ', "evidence": [{"observation": "\\ud83d\\ude00 \\\\ud800", "effect": "uncertain"}]}', None),
    (BODY[:-1] + ', "evidence": [{"observation": 1, "effect": 2, "effect": "uncertain", "observation": " x "}]}', None),
    (BODY[:-1] + ', "candidate_node_alias": " C1\\t"}', None),
    (BODY.replace('"E_sub"', '"e_sub"'), None),
    (BODY[:-1] + ', "candidate_node_alias": {"a": 1, "a": 2}}', "alias_type"),
]
#: The last one of a key that stands twice counts, in any notation of a number.
NOTATIONS_OF_NUMBERS = [("true", 1.0), ("false", 0.0), ('" +.5e0 "', 0.5), ('"1."', 1.0), ('"1_0e-1"', 1.0), ("1E-2", 0.01), ("-0", 0.0), ('"0.25"', 0.25)]


def test_notation_of_responses(spark):
    texts = [t for t, _ in NOTATIONS] + [BODY[:-1] + f', "T_policy": {v}}}' for v, _ in NOTATIONS_OF_NUMBERS]
    got = {r.raw_json: r for r in features.assess(spark.createDataFrame([("C1", t) for t in texts], "candidate_node_alias string, raw_json string")).collect()}
    assert {t: got[t].reason for t, _ in NOTATIONS} == dict(NOTATIONS)
    assert all((got[t].s_raw is None) == (got[t].reason is not None) for t in texts)
    assert [(got[t].reason, got[t].t_policy) for t in texts[len(NOTATIONS) :]] == [(None, n) for _, n in NOTATIONS_OF_NUMBERS]


def test_prompt_record(spark):
    role, text = 'made "so"\\', "line one\nline two é"
    row = spark.createDataFrame([("C1", 2, role, text)], "a string, l int, r string, t string").select(features.prompt(*[F.col(c) for c in "alrt"])).first()[0]
    record = {"candidate": {"anonymized_id": "C1", "layer": 2, "physical_role": role}, "anonymized_source_text": text, "instruction": features.INSTRUCTION}
    assert row == json.dumps(record, ensure_ascii=False, sort_keys=True)


def test_requests_and_their_schema(spark):
    """The schema names the bounds that responses are held to, and a good response of its fields passes."""
    schema = json.loads(features.response_schema())
    assert schema["required"] == sorted(GOOD) and not schema["additionalProperties"]
    assert {k: (v["minimum"], v["maximum"]) for k, v in schema["properties"].items() if v["type"] == "number"} == {"E_sub": (-1, 1), "P_pricing": (-1, 1), "T_policy": (0, 1), "confidence": (0, 1)}
    assert schema["properties"]["evidence"]["maxItems"] == 6 and schema["properties"]["evidence"]["items"]["properties"]["effect"]["enum"] == features.EFFECTS
    df = spark.createDataFrame([("C1", 2, "role", "text")], "candidate_id string, layer int, physical_role string, masked_text string")
    r = features.requests(df).first()
    assert json.loads(r.user_prompt)["candidate"] == {"anonymized_id": "C1", "layer": 2, "physical_role": "role"} and r.json_schema == features.response_schema() and "S_raw" in r.system_prompt
    assert df.select(features.output_leak(F.lit(features.SYSTEM), F.array(F.lit("Acme")))).first()[0] is None


def test_mock_events(spark):
    """The three events of the mock source go to their nodes, in the window of their day only."""
    e = seed.mock_events(spark, D(2024, 1, 5))
    routed = {(r.event_type, r.node_id) for r in routing.route(e, seed.nodes(spark)).collect()}
    assert {("qco", "COMP_TRANSFORMER_CORES"), ("trade_remedy", "COMP_SOLAR_GLASS"), ("trade_policy", "COMP_FLUOROCHEMICAL_FEED")} <= routed
    start, end = events.window_of(F.to_date(F.lit("2024-01-05")))
    late, _ = events.window_of(F.to_date(F.lit("2024-01-13")))
    assert events.in_window(e, start, end).count() == 3 and events.in_window(e, late, F.to_date(F.lit("2024-01-13"))).count() == 0
    assert e.select("event_id").distinct().count() == 3 and {r.source for r in e.collect()} == {"MOCK"}


def test_odd_pages(spark):
    """A page that can't be read is a row, and the work follows the length of the page, however many elements stay open."""
    bad = "<a href=x>y</a><![odd[page]]>"
    pages = spark.createDataFrame([("http://h/1", bad), ("http://h/2", "<p><a href=z>ok</a></p>"), ("http://h/3", None)], "url string, html string")
    assert [tuple(r) for r in html.links(pages).collect()] == [("http://h/2", "http://h/z", "ok", "ok")]
    (fault,) = html.faults(pages).collect()
    assert (fault.rule, fault.entity) == ("unreadable_page", "http://h/1") and fault.detail.startswith("AssertionError")
    assert html.page_text(bad) == ""
    began = time.perf_counter()
    n = 100_000
    assert html.page_text("<p>a" * n, 10**6) == " ".join("a" * n)
    assert html.page_text("<b>" * n + "x" + "</i>" * n + "</b>" * n + "y") == "x y"
    assert html.page_text("<p><b>a</p>" * n, 10**6) == " ".join("a" * n)
    assert len(html.page_links("<div>" + "<a href=u>" * n, "http://h/")) == n
    assert len(html.page_links("<p><a href=u>t" * 2000, "http://h/")) == 2000
    assert html.page_links("<p><a href=u>t</p>" * 3 + "<a href=v>w", None) == [("u", "t", "t")] * 3 + [("v", "w", "t t t w")]
    assert time.perf_counter() - began < 20
    with pytest.raises(ValueError, match="characters"):
        html.page_links("<a href=u>t" * n, "http://h/")
    # an element closed by its parent's end tag ends there: what follows is text again
    assert html.page_text("<nav><footer>menu</nav>text</footer> more") == "text more"
    assert html.page_text("<nav>a<nav>b</nav>c</nav>d") == "d" and html.page_text("a</nav>b") == "a b"


PAGE = '<html><head><title>T</title><script>var a="<p>";</script></head><body><nav><a href="/n">N</a></nav><p>3 Jan 2024 <a href="a/b?x=1">A <b>link</b></a> circular<br>more</p><a>no</a><a href="z"></a><footer>f</footer></body>'


def test_pages(spark):
    assert html.page_text(PAGE) == "T 3 Jan 2024 A link circular more no" and html.page_text(None) == "" and html.page_text("x" * 20_000) == "x" * 12_000
    links = html.page_links(PAGE, "http://h/d/e")
    assert ("http://h/d/a/b?x=1", "A link", "3 Jan 2024 A link circular more") in links and len(links) == 3
    pages = spark.createDataFrame([("http://h/d/e", PAGE), ("u", None)], "url string, html string")
    out = events.notices(html.links(pages), events.TRADE_POLICY, F.to_date(F.lit("2024-01-01")), F.to_date(F.lit("2024-01-31")), source="S", event_type="trade_policy").collect()
    body = "N 3 Jan 2024 A link circular more no f"  # the parent of the last link, which has no text of its own
    assert sorted((r.title, r.url, r.text) for r in out) == [("A link", "http://h/d/a/b?x=1", "3 Jan 2024 A link circular more"), (body, "http://h/d/z", body)]
    assert [r.text for r in html.with_text(pages).orderBy("url").collect()] == [html.page_text(PAGE), ""]


def test_readers_and_writers(spark, tmp_path):
    lines = spark.createDataFrame([(1, "A ", "x "), (2, "A ", "y"), (3, None, "z"), (4, "B", "w")], "line int, Symbol string, Industry string")
    assert {tuple(r) for r in tables.universe(lines, order="line", min_rows=2).collect()} == {("A.NS", "x"), ("B.NS", "w")}
    with pytest.raises(Invalid):
        tables.universe(lines, order="line")
    with pytest.raises(Invalid):
        tables.universe(lines.drop("Industry"))
    wide = spark.createDataFrame([("2024-01-01", 1.0, 2.0, float("nan"))], "Date string, `A|Close` double, `A|Open` double, `B|Close` double")
    assert [tuple(r) for r in tables.long_prices(wide).collect()] == [("A", D(2024, 1, 1), 1.0)]
    other = spark.createDataFrame([("2024-01-01", 1.0)], "Date string, `Close|A` double")
    assert tables.long_prices(other).first().ticker == "A"
    flat = spark.createDataFrame([("2024-01-01", 1.0)], "Date string, Close double")
    assert tables.long_prices(flat, ticker="Z").first().ticker == "Z"
    with pytest.raises(Invalid):
        tables.long_prices(flat)
    path = f"{tmp_path}/alpha"
    for n in (3, 5):
        sinks.write_table(spark.range(n), path)
        assert spark.read.parquet(path).count() == n
    sinks.write_metadata(spark.createDataFrame([(1, "x")], "b int, a string"), f"{tmp_path}/meta")
    assert spark.read.text(f"{tmp_path}/meta").first().value == '{"a":"x","b":1}'
    alpha, meta, ics, message = tables.read_report(spark, path, f"{tmp_path}/meta", f"{tmp_path}/none")
    assert alpha.count() == 5 and meta.first().b == 1 and ics is None and "no rank-IC" in message
    assert tables.read_report(spark, path, f"{tmp_path}/meta", path)[3].startswith("rank-IC history lacks")


def test_a_table_is_there_at_every_moment(spark, tmp_path, monkeypatch):
    """A driver that dies between any two steps of a commit leaves the old or the new version at the name."""
    path = f"{tmp_path}/alpha"
    n = lambda: tables.read_table(spark, path).count()
    sinks.commit_table(spark.range(3), path)
    assert n() == 3
    steps = ["written", "pointed", "cleaned"]
    for at, step in enumerate(steps):
        with monkeypatch.context() as m:
            if step == "written":
                m.setattr(sinks, "_point", lambda *a: 1 / 0)
            if step == "pointed":
                plain = sinks._point
                m.setattr(sinks, "_point", lambda *a: (plain(*a), 1 / 0))
            try:
                sinks.commit_table(spark.range(10 + at), path)
            except ZeroDivisionError:
                pass
        assert n() == (3 if step == "written" else 10 + at)
    held = tables.read_table(spark, path)
    sinks.commit_table(spark.range(20), path)
    assert n() == 20 and held.count() == 12  # a reader at the version before goes on
    kept = [p.name for p in (tmp_path / "alpha").iterdir() if p.name.startswith("version-")]
    assert len(kept) == 2
    with pytest.raises(Exception, match="boom"):
        sinks.commit_table(spark.range(5).select(F.raise_error(F.lit("boom"))), path)
    assert n() == 20
    sinks.commit_metadata(spark.createDataFrame([(1, "x")], "b int, a string"), f"{tmp_path}/meta")
    alpha, meta, ics, message = tables.read_report(spark, path, f"{tmp_path}/meta", f"{tmp_path}/none")
    assert alpha.count() == 20 and meta.first().b == 1 and ics is None
    spark.range(4).write.parquet(f"{tmp_path}/plain")
    assert tables.read_table(spark, f"{tmp_path}/plain").count() == 4


def test_stream_keeps_the_first_of_each(spark, tmp_path):
    e = raw_event(spark, [("A", D(2024, 1, 1), "x", "1", "", None, T0), ("A", D(2024, 1, 1), "x", "1", "again", None, T0), ("A", D(2024, 1, 1), "x", "2", "", None, T0)])
    e.write.parquet(f"{tmp_path}/in")
    stream = first_of_each(spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("firsts").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("firsts").count() == 2


def test_references_without_their_semicolon():
    page = "<title>a &amp;&amp</title><p>&copy;&copy b &ampc &amp;amp &unknown; &#65;&#66 x&y</p>"
    assert html.page_text(page) == "a && ©© b &c &amp &unknown; AB x&y"
    assert html.page_text(page, open_references=False) == "a &&amp ©&copy b &ampc &amp &unknown; A&#66 x&y"
    assert html.page_text(None, open_references=False) == ""


def test_page_texts_of_titles_cut_within_a_reference(spark, tmp_path):
    from tideline.plans.registry import ORACLES, QUERIES

    rows = [(1, "u", "<html><head><title>One &amp;&amp</title></head><body><p>two &quot;three&quot;</p></body></html>"), (2, "v", "<p>&copy; four</p>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {tuple(r) for r in QUERIES["page_texts"](spark, str(tmp_path)).collect()}
    assert got == in_duckdb(ORACLES["page_texts"], tmp_path, "pages") == {(1, 'One &&amp two "three"'), (2, "© four")}


def test_event_ids_where_instants_repeat(spark, tmp_path):
    from tideline.plans.registry import ORACLES, QUERIES

    at = [dt.datetime(2024, 1, 1, 5), dt.datetime(2024, 1, 1, 5), dt.datetime(2024, 1, 2, 6, 7, 8, 9), None]
    rows = [(i, t, 10 + i, "view", 1.25 * i, f'{{"k": {i}}}') for i, t in enumerate(at)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = [tuple(r) for r in QUERIES["event_ids"](spark, str(tmp_path)).collect()]
    assert len(got) == 5 and set(got) == in_duckdb(ORACLES["event_ids"], tmp_path, "events") and {r[-1] for r in got} == {"0", "1", "2"}


def in_duckdb(sql, folder, *tables):
    """The rows of a query's SQL over Parquet folders."""
    import duckdb

    con = duckdb.connect()
    for t in tables:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    return set(con.sql(sql).fetchall())
