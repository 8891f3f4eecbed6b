"""Event ingestion: normalisation, ids, windows, keywords, sources, deduplication.

Events have the columns of ``EVENT_COLUMNS``; sources are DataFrames of raw rows. Rows that can't become an event (no title, no date)
are left out; ``skipped`` variants are plain anti-filters of the same predicates.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import extract_date, field_date
from ..functions.quality import together
from ..functions.strings import collapse, strip

EVENT_COLUMNS = ["event_id", "source", "event_type", "published_date", "title", "url", "text", "fetched_at_utc", "metadata"]

# The keyword lists of the two notice sources, as they are; "trade remed" stands between word bounds and so never
# matches inside a longer word.
TRADE_REMEDY = r"\b(anti[- ]dumping|countervailing|anti[- ]subsidy|final findings?|final finding|initiation|trade remed|safeguard)\b"
TRADE_POLICY = r"\b(notification|public notice|trade notice|policy circular|circular|import|export)\b"


def keyword_match(text: Column, pattern: str) -> Column:
    """Case and word bounds by Unicode rules."""
    return text.rlike("(?iU)" + pattern)


def empty_map() -> Column:
    return F.create_map().cast("map<string,string>")


def make_events(df: DataFrame, *, source: Column, event_type: Column, published_date: Column, title: Column, url: Column, text: Column | None = None, metadata: Column | None = None, fetched_at: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Events of raw rows: the id is the SHA-256 of ``source|type|date|lower title|url``; lower-casing stands in for case folding."""
    df = df.select(
        source.alias("source"),
        event_type.alias("event_type"),
        published_date.cast("date").alias("published_date"),
        collapse(F.coalesce(title, F.lit(""))).alias("title"),
        F.coalesce(url, F.lit("")).alias("url"),
        strip(F.coalesce(text if text is not None else F.lit(""), F.lit(""))).alias("text"),
        (F.current_timestamp() if fetched_at is None else fetched_at).alias("fetched_at_utc"),
        F.coalesce(metadata if metadata is not None else empty_map(), empty_map()).alias("metadata"),
        *keep,
    )
    day = F.date_format("published_date", "yyyy-MM-dd")
    event_id = F.sha2(F.concat_ws("|", "source", "event_type", day, F.lower("title"), "url"), 256)
    return df.withColumn("event_id", event_id).select(*EVENT_COLUMNS, *keep)


def searchable(title: str = "title", text: str = "text") -> Column:
    return F.concat_ws("\n", title, text)


def window_of(today: Column, lookback_days: int = 7) -> tuple[Column, Column]:
    if lookback_days < 1:
        raise ValueError("lookback_days must be 1 at least")
    return F.date_sub(today, lookback_days - 1), today


def in_window(events: DataFrame, start: Column, end: Column) -> DataFrame:
    """Both ends belong to the window."""
    return events.where(F.col("published_date").between(start, end))


def quality_orders(table: DataFrame, start: Column, end: Column, url: str, *, source: str = "BIS", ahead_days: int = 180) -> DataFrame:
    """Orders that take effect from ``start`` to ``ahead_days`` after ``end``; columns are found by what their names contain.

    The event's date is the enforcement date, or ``end`` for later ones; the whole date field is read, not a text with a date in it. A table without product or date column gives no events.
    """
    names = {c.strip().lower(): c for c in table.columns}

    def column(*parts: str) -> str | None:
        return next((c for n, c in names.items() if any(p in n for p in parts)), None)

    product, day, ministry, standard = column("product"), column("enforcement", "implementation"), column("ministry"), column("standard")
    if product is None or day is None:
        table, product, day = table.sparkSession.createDataFrame([], "product string, enforcement string"), "product", "enforcement"
    either = lambda c: F.col(f"`{c}`").cast("string") if c else F.lit("")
    df = table.select(strip(either(product)).alias("product"), field_date(either(day)).alias("enforcement"), F.coalesce(either(ministry), F.lit("nan")).alias("ministry"), F.coalesce(either(standard), F.lit("nan")).alias("standard"))
    df = df.where((F.col("product") != "") & (F.lower("product") != "nan") & F.col("enforcement").between(start, F.date_add(end, ahead_days)))
    iso = F.date_format("enforcement", "yyyy-MM-dd")
    text = F.concat(F.lit("Product: "), "product", F.lit(". Enforcement date: "), iso, F.lit(". Ministry/Department: "), "ministry", F.lit(". Indian Standard: "), "standard", F.lit("."))
    return make_events(df, source=F.lit(source), event_type=F.lit("qco"), published_date=F.least("enforcement", end), title=F.concat(F.lit("Quality Control Order: "), "product"), url=F.lit(url), text=text, metadata=F.create_map(F.lit("enforcement_date"), iso, F.lit("product"), F.col("product")))


ANNOUNCEMENT_FIELDS = ["NEWSSUB", "HEADLINE", "NEWS_SUB", "NEWS_DT", "DissemDT", "DT_TM", "ATTACHMENTNAME", "SLONGNAME", "LONG_NAME", "SCRIP_CD", "CATEGORYNAME"]


def announcements(rows: DataFrame, start: Column, end: Column, *, attachment_base: str, default_url: str, documents: DataFrame | None = None, source: str = "BSE") -> DataFrame:
    """Corporate announcements: the first non-empty title, date and name fields; ``documents(url, text)`` holds attachments' texts."""
    rows = rows.select(*[(F.col(f) if f in rows.columns else F.lit(None)).cast("string").alias(f) for f in ANNOUNCEMENT_FIELDS])
    first = lambda *fs: F.coalesce(*[F.nullif(F.col(f), F.lit("")) for f in fs], F.lit(""))
    attachment = strip(first("ATTACHMENTNAME"))
    url = F.when(attachment == "", F.lit(default_url)).when(attachment.startswith("http"), attachment).otherwise(F.concat(F.lit(attachment_base), attachment))
    df = rows.select(strip(first("NEWSSUB", "HEADLINE", "NEWS_SUB")).alias("title"), field_date(first("NEWS_DT", "DissemDT", "DT_TM")).alias("day"), url.alias("url"), (attachment != "").alias("attached"), strip(first("SLONGNAME", "LONG_NAME")).alias("company"), strip(first("SCRIP_CD")).alias("code"), strip(first("CATEGORYNAME")).alias("category"))
    df = df.where((F.col("title") != "") & F.col("day").between(start, end))
    if documents is not None:
        df = df.join(documents.select("url", F.col("text").alias("body")), "url", "left")
    else:
        df = df.withColumn("body", F.lit(None).cast("string"))
    body = F.when(F.col("attached"), F.nullif(F.col("body"), F.lit("")))
    meta = F.create_map(F.lit("company_name"), F.col("company"), F.lit("scrip_code"), F.col("code"), F.lit("category"), F.col("category"))
    return make_events(df, source=F.lit(source), event_type=F.lit("corporate_announcement"), published_date=F.col("day"), title=F.col("title"), url=F.col("url"), text=F.coalesce(body, F.col("title")), metadata=meta)


def notices(links: DataFrame, pattern: str, start: Column, end: Column, *, source: str, event_type: str, documents: DataFrame | None = None) -> DataFrame:
    """``links(url, title, context)`` of a notice page: kept by keyword, date and window; the text is the linked document's or the context."""
    df = links.where(keyword_match(F.col("context"), pattern)).withColumn("day", extract_date(F.col("context"))).where(F.col("day").between(start, end))
    if documents is not None:
        df = df.join(documents.select("url", F.col("text").alias("body")), "url", "left")
    else:
        df = df.withColumn("body", F.lit(None).cast("string"))
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("context"))
    return make_events(df, source=F.lit(source), event_type=F.lit(event_type), published_date=F.col("day"), title=title, url=F.col("url"), text=F.coalesce(F.nullif(F.col("body"), F.lit("")), F.col("context")))


def merged(sources: list[DataFrame], order: Column | None = None) -> DataFrame:
    """The union of the sources, one row an event id: the last source's, and of one source the row that ``order`` puts last.

    Rows are ranked by id only after the date filters of the sources; ``order`` defaults to the fetch time.
    """
    tagged = together([s.select(*EVENT_COLUMNS, *(c for c in s.columns if c not in EVENT_COLUMNS)).withColumn("_source", F.lit(i)) for i, s in enumerate(sources)])
    last = Window.partitionBy("event_id").orderBy(F.desc("_source"), F.desc(order if order is not None else F.col("fetched_at_utc")), F.desc("text"))
    return tagged.withColumn("_rn", F.row_number().over(last)).where("_rn = 1").drop("_rn", "_source")


def ordered(events: DataFrame) -> DataFrame:
    return events.orderBy("published_date", "source", "event_id")


def collected(spark, sources: Mapping[str, Callable[[], DataFrame]], keep: Callable[[DataFrame, str], DataFrame]) -> tuple[DataFrame | None, DataFrame]:
    """(merged events or None, status): each source is forced by ``keep`` (a write, say) on its own, so that one failure is recorded and the others go on."""
    good, status = [], []
    for name, source in sources.items():
        try:
            df = keep(source(), name)
            good.append(df)
            status.append((name, df.count(), None))
        except Exception as error:  # noqa: BLE001  whatever a source raises is its status
            status.append((name, 0, f"{type(error).__name__}: {str(error).splitlines()[0] if str(error) else ''}"))
    table = spark.createDataFrame(status, "source string, n_events long, error string")
    return (merged(good) if good else None), table
