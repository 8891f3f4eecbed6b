"""Personal data: fixed patterns, then information-theoretic sanitisation of terms that reveal what the patterns found.

The values of the patterns are the protected entities. Candidates are the whole words next to an entity, ``window`` on each side,
that stand so in ``min_texts`` different texts, so that one text and its copies prove nothing. A candidate discloses its entity as far
as the corpus says so: ``PMI(term; entity) = log2(n(t,e) N / (n(t) n(e)))`` against ``IC(entity) = log2(N / n(e))``, with every n
counted in documents over their whole texts. A term whose ratio PMI / IC reaches ``generalise_at`` for any entity is generalised
wherever it stands, in documents without the entity too, where it would give the entity away; from ``remove_at`` on it is
removed. To generalise a term is to cut it to its longest beginning that so many words share that this ratio stays under
``generalise_at`` (n of a beginning is summed over its words, n(t,e) is the term's own), written with an ellipsis; a term
without such a beginning becomes ``[TERM]``.

Defined cases: a null text counts as empty; a pattern match that fails its check is dropped and not tried again; term spans that
overlap a base span are left out; repeated rows and equal texts get equal spans; words of over ``reach`` letters are no candidates;
an empty table gives an empty result; extra columns pass through whatever their names.

Scale: DataFrame functions only. Texts are scanned once for patterns and written; contexts are aggregated before they are
shuffled; co-occurrence is counted by intersecting a document's words with an entity's candidates, so that rows are only made for what
does occur; document frequencies are one partial aggregate over all words.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: Kinds in the order of the contract; possessive loops, which match the same and need no stack for long runs. A match starts where a
#: run of its first characters starts, or where the last match ended, so that a long run is read once and not from each of its characters.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # A whole run of digits with single separators, if it has 14 to 19 digits: other runs fail the check anyway.
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
KINDS = [*PATTERNS, "term"]
NEEDLE = {"email": "@", "phone": "+"}
WORD = r"\p{L}{3,}"
NO_SPANS = "array<struct<start:int,kind:int,end:int>>"


def luhn(digits: F.Column) -> F.Column:
    n = F.length(digits)

    def add(total, i):
        d = F.substr(digits, n - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def passes(kind: str, m: F.Column) -> F.Column:
    if kind == "ip":
        short = lambda part: F.ltrim(part, F.lit("0"))
        return F.forall(F.split(m, r"\."), lambda part: (F.length(short(part)) <= 3) & (F.coalesce(F.nullif(short(part), F.lit("")), F.lit("0")).try_cast("int") <= 255))
    if kind == "card":
        return luhn(F.regexp_replace(m, "[^0-9]", ""))
    if kind == "phone":
        return F.length(F.regexp_replace(m, "[^0-9]", "")).between(10, 15)
    return F.lit(True)


#: Matches are placed in runs of this many, so that the work grows little faster than their number.
RUN = 256


def bound(value: F.Column, use) -> F.Column:
    """``use`` of a value that is computed once: the variable of a one-element transform."""
    return F.get(F.transform(F.array(value), use), 0)


def running(lens: F.Column) -> F.Column:
    """The sum of all numbers up to each one, itself included."""
    none = F.array().cast("array<int>")
    last = lambda acc: F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0))
    grow = lambda acc, n: F.concat(acc, F.array(last(acc) + n))

    def by_runs(lens: F.Column) -> F.Column:
        many = F.greatest(F.ceil(F.size(lens) / RUN).cast("int") - 1, F.lit(0))
        return F.transform(F.sequence(F.lit(0), many), lambda c: F.aggregate(F.slice(lens, c * RUN + 1, F.lit(RUN)), none, grow))

    def joined(x: F.Column) -> F.Column:
        shift = lambda r, i: F.transform(r, lambda n: n + F.when(i > 0, F.element_at(x["ends"], F.greatest(i, F.lit(1)))).otherwise(0))
        return F.flatten(F.transform(x["runs"], shift))

    with_ends = lambda runs: F.struct(runs.alias("runs"), F.aggregate(F.transform(runs, last), none, grow).alias("ends"))
    return bound(bound(bound(lens, by_runs), with_ends), joined)


def located(text: F.Column, pattern: F.Column | str) -> F.Column:
    """array<struct<start,end,value>> of the matches: what lies between them gives their places, in code points."""
    rx = F.lit(pattern) if isinstance(pattern, str) else pattern
    parts = F.struct(F.split(text, rx, -1).alias("gaps"), F.regexp_extract_all(text, rx, F.lit(0)).alias("hits"))

    def place(x: F.Column) -> F.Column:
        ends = running(F.transform(x["hits"], lambda h, i: F.length(h) + F.length(F.get(x["gaps"], i))))
        return F.transform(F.arrays_zip(ends.alias("end"), x["hits"].alias("value")), lambda z: F.struct((z["end"] - F.length(z["value"])).alias("start"), z["end"].alias("end"), z["value"].alias("value")))

    found = bound(parts, place)
    return F.when(F.rlike(text, rx), found).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def base_spans(text: F.Column) -> F.Column:
    """array<struct<start,kind,end,value>> of the patterns, by start, then kind."""

    def of(k: int, kind: str, rx: str) -> F.Column:
        ok = F.filter(located(text, rx), lambda x: passes(kind, x["value"]))
        some = F.transform(ok, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end"), x["value"].alias("value")))
        worth = F.contains(text, F.lit(NEEDLE.get(kind, "")))
        return F.when(worth, some).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>"))

    return F.array_sort(F.concat(*[of(k, kind, rx) for k, (kind, rx) in enumerate(PATTERNS.items())]))


def words_of(text: F.Column) -> F.Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))


def contexts(text: F.Column, base: F.Column, window: int, reach: int) -> F.Column:
    """Per base span: struct(entity, terms): the distinct lower-cased whole words next to it, ``window`` on each side at most."""

    # One character more than ``reach`` shows whether the outermost word is cut.
    words = lambda side: F.regexp_extract_all(F.lower(side), F.lit(WORD), F.lit(0))

    def near(x):
        cut_left, cut_right = x["start"] > reach, F.length(text) - x["end"] > reach
        left = F.substr(text, F.greatest(x["start"] - reach, F.lit(1)), F.least(x["start"], F.lit(reach + 1)))
        right = F.substr(text, x["end"] + 1, F.lit(reach + 1))
        before = words(F.regexp_replace(left, F.when(cut_left, r"^\p{L}+").otherwise(r"\z"), F.lit("")))
        after = words(F.regexp_replace(right, F.when(cut_right, r"\p{L}+$").otherwise(r"\z"), F.lit("")))
        last = lambda ws: F.reverse(F.slice(F.reverse(ws), 1, window))
        entity = F.concat(F.element_at(F.array(*[F.lit(f"{k}:") for k in KINDS]), x["kind"] + 1), x["value"])
        return F.struct(entity.alias("entity"), F.array_distinct(F.concat(last(before), F.slice(after, 1, window))).alias("terms"))

    return F.transform(base, near)


def disclosing(some: DataFrame, words: DataFrame, total: int, *, min_texts: int, generalise_at: float) -> DataFrame:
    """(entity, term, n_e, n_te, ratio) of the terms that reveal an entity. some(uid, text, near); words(term, n_t)."""
    near = some.select("uid", F.xxhash64("text").alias("text_key"), F.explode("near").alias("x")).select("uid", "text_key", "x.entity", "x.terms")
    texts = near.select("text_key", "entity", F.explode("terms").alias("term")).groupBy("entity", "term", "text_key").agg(F.count("*").alias("k"))
    likely = texts.groupBy("entity", "term").agg(F.count("*").alias("texts")).where(F.col("texts") >= min_texts)
    likely = likely.groupBy("entity").agg(F.collect_list("term").alias("candidates"))
    held = near.select("uid", "entity").distinct()
    n_e = held.groupBy("entity").agg(F.count("*").alias("n_e"))
    both = held.join(likely, "entity").join(some.select("uid", words_of(F.col("text")).alias("words")), "uid")
    both = both.select("entity", F.explode(F.array_intersect("candidates", "words")).alias("term")).groupBy("entity", "term").agg(F.count("*").alias("n_te"))
    df = both.join(n_e, "entity").join(words, "term")
    ratio = F.log2(F.col("n_te") * float(total) / (F.col("n_t") * F.col("n_e"))) / F.log2(F.lit(float(total)) / F.col("n_e"))
    return df.where(F.col("n_e") < total).withColumn("ratio", ratio).where(F.col("ratio") >= generalise_at).select("entity", "term", "n_e", "n_te", "ratio")


def general_forms(reveal: DataFrame, words: DataFrame, total: int, *, generalise_at: float, remove_at: float) -> DataFrame:
    """(term, to): what each term becomes."""
    worst = reveal.groupBy("term").agg(F.max("ratio").alias("ratio"))
    cut = worst.where(F.col("ratio") < remove_at).where(F.length("term") > 1)
    beginnings = cut.select("term", F.explode(F.sequence(F.lit(1), F.length("term") - 1)).alias("size")).select("term", "size", F.substr("term", F.lit(1), F.col("size")).alias("start"))
    needed = beginnings.select("start").distinct()
    longest = F.least(F.length("term"), F.lit(64))
    shared = words.select("n_t", F.explode(F.transform(F.sequence(F.lit(1), longest), lambda i: F.substr("term", F.lit(1), i))).alias("start")).join(needed, "start")
    shared = shared.groupBy("start").agg(F.least(F.sum("n_t"), F.lit(total)).alias("n_s"))
    told = beginnings.join(shared, "start").join(reveal.select("term", "n_e", "n_te"), "term")
    ratio = F.log2(F.col("n_te") * float(total) / (F.col("n_s") * F.col("n_e"))) / F.log2(F.lit(float(total)) / F.col("n_e"))
    safe = told.groupBy("term", "start", "size").agg(F.max(ratio).alias("ratio")).where(F.col("ratio") < generalise_at)
    safe = safe.groupBy("term").agg(F.max_by("start", "size").alias("start"))
    form = F.when(F.col("ratio") >= remove_at, "").otherwise(F.coalesce(F.concat("start", F.lit("…")), F.lit("[TERM]")))
    return worst.join(safe, "term", "left").select("term", form.alias("to"))


def find(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None, window: int = 5, reach: int = 120, min_texts: int = 3, generalise_at: float = 0.8, remove_at: float = 0.95) -> DataFrame:
    """Per document: ``row`` (the kept columns), text (null as empty), base and extra spans.

    base: array<struct<start,kind,end,value>>; extra: array<struct<start,kind,end,to>>, ``to`` being what the term becomes.
    """
    keep = docs.columns if keep is None else keep
    df = docs.select(F.struct(*[docs[c] for c in keep]).alias("row"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
    df = df.withColumn("base", base_spans(F.col("text")))
    df = df.withColumn("near", F.when(F.size("base") > 0, contexts(F.col("text"), F.col("base"), window, reach)))
    df = written(df.withColumn("uid", F.monotonically_increasing_id()), "pii-spans")

    total = docs.count()
    each = df.select("uid", F.explode(words_of(F.col("text"))).alias("term"))
    words = written(each.groupBy("term").agg(F.count("*").alias("n_t")), "pii-words")
    reveal = written(disclosing(df.where(F.size("base") > 0), words, total, min_texts=min_texts, generalise_at=generalise_at), "pii-reveal")
    terms = written(general_forms(reveal, words, total, generalise_at=generalise_at, remove_at=remove_at), "pii-terms")
    marked = each.join(terms, "term").groupBy("uid").agg(F.collect_list(F.struct("term", "to")).alias("terms"))
    df = df.drop("near").join(marked, "uid", "left")

    def places(t):
        rx = F.concat(F.lit(r"(?iu)(?<![\p{L}])"), t["term"], F.lit(r"(?![\p{L}])"))
        return F.transform(located(F.col("text"), rx), lambda x: F.struct(x["start"].alias("start"), F.lit(len(PATTERNS)).alias("kind"), x["end"].alias("end"), t["to"].alias("to")))

    none = F.array().cast("array<struct<start:int,kind:int,end:int,to:string>>")
    extra = F.when(F.col("terms").isNotNull(), F.array_sort(F.flatten(F.transform("terms", places)))).otherwise(none)
    extra = F.filter(extra, lambda x: ~F.exists("base", lambda b: (x["start"] < b["end"]) & (b["start"] < x["end"])))
    return df.select("row", "text", "base", extra.alias("extra"))


def spans_text(spans: F.Column) -> F.Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def merged_spans(base: F.Column, extra: F.Column) -> F.Column:
    plain = lambda a: F.transform(a, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    return F.array_sort(F.concat(plain(base), plain(extra)))


def masked(text: F.Column, base: F.Column, extra: F.Column) -> F.Column:
    """The text with base spans replaced by their kind, and terms by what they become.

    Where spans overlap (a card inside a phone number, say), the one that starts later only covers what is left.
    """
    label = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    one = F.transform(base, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.element_at(label, x["kind"] + 1).alias("to")))
    two = F.transform(extra, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["to"].alias("to")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, x):
        fresh = x["start"] >= acc["at"]
        piece = F.when(fresh, F.array(F.substr(text, acc["at"] + 1, x["start"] - acc["at"]), x["to"])).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.concat(acc["out"], piece).alias("out"))

    return F.aggregate(F.array_sort(F.concat(one, two)), start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, acc["at"] + 1, F.length(text))))


def sanitise(docs: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """``docs`` with the text sanitised, other columns as they are; a null text stays null."""
    others = [docs[c] for c in docs.columns if c != text]
    packed = docs.select(F.struct(docs[text].isNull().alias("none"), F.struct(*(others or [F.lit(0).alias("none")])).alias("others")).alias("row"), docs[text].cast("string").alias("text"))
    out = find(packed, keep=["row"], **options)
    touched = (F.size("base") > 0) | (F.size("extra") > 0)
    clean = F.when(F.col("row.row.none"), None).when(touched, masked(F.col("text"), F.col("base"), F.col("extra"))).otherwise(F.col("text"))
    return out.select(*[clean.alias(c) if c == text else F.col(f"row.row.others.`{c}`").alias(c) for c in docs.columns])


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find(table(spark, sf_dir, "documents"), keep=["doc_id"])
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("bigint")
    return out.select("row.*", *[count(k).alias(f"n_{kind}") for k, kind in enumerate(PATTERNS)], F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(merged_spans(F.col("base"), F.col("extra"))).alias("spans"))


_KIND_SQL = " UNION ALL ".join(
    f"SELECT rid, {k} AS kind, '{kind}' AS name, unnest(range(1, len(hits) + 1)) AS j, unnest(hits) AS hit, unnest(list_slice(gaps, 1, len(hits))) AS gap FROM (SELECT rid, regexp_extract_all(t, '{rx}') AS hits, string_split_regex(t, '{rx}') AS gaps FROM d)"
    for k, (kind, rx) in enumerate({"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}.items())
)
ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
raw AS ({_KIND_SQL}),
placed AS (SELECT *, regexp_replace(hit, '[^0-9]', '', 'g') AS digits, (sum(length(gap) + length(hit)) OVER (PARTITION BY rid, kind ORDER BY j))::BIGINT AS e FROM raw),
base AS (
  SELECT rid, kind, name, hit, e - length(hit) AS s, e FROM placed WHERE CASE kind
    WHEN 0 THEN true
    WHEN 1 THEN list_bool_and(list_transform(string_split(hit, '.'), lambda x: length(ltrim(x, '0')) <= 3 AND coalesce(try_cast(nullif(ltrim(x, '0'), '') AS INT), 0) <= 255))
    WHEN 2 THEN length(digits) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(digits, length(digits) - i + 1, 1)::INT
      ELSE CASE WHEN 2 * substr(digits, length(digits) - i + 1, 1)::INT > 9 THEN 2 * substr(digits, length(digits) - i + 1, 1)::INT - 9 ELSE 2 * substr(digits, length(digits) - i + 1, 1)::INT END END)) % 10 = 0
    ELSE length(digits) BETWEEN 10 AND 15 END),
near AS (SELECT rid, t, name || ':' || hit AS entity, list_distinct(list_concat(w1[greatest(len(w1) - 4, 1):], w2[1:5])) AS terms FROM (
  SELECT rid, t, name, hit, regexp_extract_all(lower(CASE WHEN s > 120 THEN regexp_replace(substr(t, s - 120, 121), '^\p{{L}}+', '') ELSE substr(t, 1, s) END), '\p{{L}}{{3,}}') AS w1,
    regexp_extract_all(lower(CASE WHEN length(substr(t, e + 1, 121)) > 120 THEN regexp_replace(substr(t, e + 1, 121), '\p{{L}}+$', '') ELSE substr(t, e + 1, 121) END), '\p{{L}}{{3,}}') AS w2 FROM base JOIN d USING (rid))),
held AS (SELECT DISTINCT rid, entity FROM near),
n_e AS (SELECT entity, count(*) AS n_e FROM held GROUP BY entity),
likely AS (SELECT entity, term FROM (SELECT DISTINCT entity, t, unnest(terms) AS term FROM near) GROUP BY ALL HAVING count(*) >= 3),
dw AS MATERIALIZED (SELECT rid, unnest(list_distinct(regexp_extract_all(lower(t), '\p{{L}}{{3,}}'))) AS term FROM d),
n_te AS (SELECT entity, term, count(*) AS n_te FROM held JOIN likely USING (entity) JOIN dw USING (rid, term) GROUP BY ALL),
n_t AS (SELECT term, count(*) AS n_t FROM dw GROUP BY term),
reveal AS (SELECT DISTINCT term FROM n_te JOIN n_e USING (entity) JOIN n_t USING (term), (SELECT count(*)::DOUBLE AS n FROM documents) WHERE n_e < n AND log2(n_te * n / (n_t * n_e)) / log2(n / n_e) >= 0.8),
marked AS (SELECT rid, term FROM dw JOIN reveal USING (term)),
words AS (SELECT rid, unnest(range(1, len(hits) + 1)) AS j, unnest(hits) AS hit, unnest(list_slice(gaps, 1, len(hits))) AS gap FROM (SELECT rid, regexp_extract_all(t, '\p{{L}}+') AS hits, string_split_regex(t, '\p{{L}}+') AS gaps FROM d WHERE rid IN (SELECT rid FROM marked))),
located AS (SELECT rid, lower(hit) AS term, length(hit) AS n, (sum(length(gap) + length(hit)) OVER (PARTITION BY rid ORDER BY j))::BIGINT AS e FROM words),
extra AS (SELECT rid, 4 AS kind, 'term' AS name, located.e - n AS s, located.e FROM located JOIN marked USING (rid, term) WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = located.rid AND located.e - n < b.e AND b.s < located.e)),
every AS (SELECT rid, kind, name, s, e FROM base UNION ALL SELECT * FROM extra),
lines AS (SELECT rid, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2, count(*) FILTER (kind = 3) AS n3,
  string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER (kind < 4) AS b, string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) AS a FROM every GROUP BY rid)
SELECT doc_id, coalesce(n0, 0)::BIGINT AS n_email, coalesce(n1, 0)::BIGINT AS n_ip, coalesce(n2, 0)::BIGINT AS n_card, coalesce(n3, 0)::BIGINT AS n_phone, sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans FROM d LEFT JOIN lines USING (rid)
"""
