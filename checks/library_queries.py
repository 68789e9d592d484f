"""Library filters, paging, joins, set operations, sinks and display text."""

from __future__ import annotations

from pyspark.sql import functions as F

from kairoscope.functions import text as X
from kairoscope.operators import audit, filters, ranking, temporal
from kairoscope.plans import reports
from kairoscope.schemas import SEARCH_REQUEST, SearchParams
from kairoscope.sources import sinks, tables
from kairoscope.staging import new_path, stage

from . import sql as S
from . import views as V
from .registry import query
from .views import longs, rounded, table

LIBRARY = """library as (
  select o_orderkey video_id, lower(o_orderpriority) || '_' || o_orderkey || '.mp4' filename, o_totalprice size_bytes,
         o_orderstatus status, case o_orderstatus when 'P' then 'image' else 'video' end media_type,
         case when o_orderstatus <> 'P' then o_totalprice / 100 end duration_seconds, o_orderdate uploaded_at
  from orders)"""
ITEM = "video_id, filename, status, strftime(uploaded_at, '%Y-%m-%d') uploaded"


def _items(df):
    return df.select("video_id", "filename", "status", X.to_iso_date(F.col("uploaded_at")).alias("uploaded"))


def _where(name, condition_sql, build):
    @query(name, f"with {LIBRARY} select {ITEM} from library where {condition_sql}")
    def run(spark, d):
        return _items(V.library(spark, d).filter(build()))


_where("p3_date_range", "uploaded_at >= '1997-03-01' and uploaded_at < '1998-01-01'", lambda: filters.date_range("uploaded_at", "1997-03-01", "1997-12-31"))
_where("p3_date_from_only", "uploaded_at >= '1999-06-01'", lambda: filters.date_range("uploaded_at", "1999-06-01", ""))
_where("p4_quick_range_30d", "uploaded_at >= date '1998-08-02' - 30 and uploaded_at < date '1998-08-02' + 1", lambda: filters.quick_range("uploaded_at", filters.QUICK_RANGES["30d"], "1998-08-02"))
_where("p4_quick_range_today", "uploaded_at >= date '1998-08-02' and uploaded_at < date '1998-08-02' + 1", lambda: filters.quick_range("uploaded_at", filters.QUICK_RANGES["today"], "1998-08-02"))
_where("p5_media_type", "media_type = 'image'", lambda: filters.media_type_is("image", ("image", "video")))
_where("p6_duration_range", "duration_seconds >= 600 and duration_seconds <= 1800", lambda: filters.duration_between(600, 1800))
_where("p7_status", "status = 'F'", lambda: filters.status_is("F"))
_where("p9_metadata_words", "contains(filename, 'urgent') and (contains(filename, '77') or contains(media_type, '77'))", lambda: filters.metadata_match("Urgent  77", ("filename", "media_type")))
_where("p10_library_search", "contains(filename, 'medium_1')", lambda: filters.library_search("MEDIUM_1"))


@query(
    "p11_query_guard",
    r"select conv_id, turn, trim(text, e' \t\r\n\f\v') query from conversations where trim(text, e' \t\r\n\f\v') <> ''",
)
def p11(spark, d):
    log = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("query"))
    return ranking.guard_queries(log)


NAMED = """named as (
  select p_partkey, case p_partkey % 7 when 0 then 'IMG ' || p_partkey || '.PNG' when 1 then 'clip' || p_partkey when 2 then 'v.' || p_partkey || '.webm'
           when 3 then 'a/b.jpeg' when 4 then 'notes.txt' when 5 then 'still' || p_partkey || '.GIF' else 'movie.MKV' end filename,
         case p_partkey % 5 when 0 then 'image/png' when 1 then 'video/mp4' when 2 then '' when 3 then 'application/pdf' end mime
  from part)"""


def _named(spark, d):
    key = F.col("p_partkey")
    text = key.cast("string")
    kind, mime = F.pmod(key, F.lit(7)), F.pmod(key, F.lit(5))
    name = (
        F.when(kind == 0, F.concat(F.lit("IMG "), text, F.lit(".PNG")))
        .when(kind == 1, F.concat(F.lit("clip"), text))
        .when(kind == 2, F.concat(F.lit("v."), text, F.lit(".webm")))
        .when(kind == 3, "a/b.jpeg").when(kind == 4, "notes.txt")
        .when(kind == 5, F.concat(F.lit("still"), text, F.lit(".GIF"))).otherwise("movie.MKV")
    )
    sent = F.when(mime == 0, "image/png").when(mime == 1, "video/mp4").when(mime == 2, "").when(mime == 3, "application/pdf")
    return table(spark, d, "part").select(key, name.alias("filename"), sent.alias("mime"))


# The extensions by kind.
@query(
    "p12_media_kind",
    f"""with {NAMED}, e as (select *, lower(case when contains(filename, '.') then regexp_extract(filename, '(\\.[^.]*)$', 1) else right(filename, 1) end) ext from named)
    select p_partkey, ext, case when mime like 'image/%' then 'image' when mime like 'video/%' then 'video'
        when ext in ('.jpg', '.jpeg', '.png', '.webp', '.gif') then 'image' else 'video' end kind,
      coalesce(mime like 'image/%' or mime like 'video/%', false) or ext in ('.jpg', '.jpeg', '.png', '.webp', '.gif', '.mp4', '.mov', '.avi', '.mkv', '.webm', '.m4v', '.mpg', '.mpeg', '.ts', '.flv', '.wmv') accepted
    from e""",
)
def p12(spark, d):
    name, mime = F.col("filename"), F.col("mime")
    return _named(spark, d).select(
        "p_partkey", filters.extension(name).alias("ext"), filters.media_kind(name, mime).alias("kind"),
        filters.accepted_upload(name, mime).alias("accepted"),
    )


# Role and status names.
USERS = """users as (
  select c_custkey uid, lower(c_name) || '@example.org' email,
         case c_mktsegment when 'MACHINERY' then 'ADMIN' when 'BUILDING' then 'VIDEO_EDITOR' else 'SEARCHER' end as role,
         case when c_acctbal < 0 then 'REVOKED' else 'ACTIVE' end status
  from customer)"""


@query(
    "p13_access_audit",
    f"""with {USERS}, calls as (select o_orderkey, o_custkey * 3 // 2 uid from orders)
    select o_orderkey, c.uid, case when u.uid is null then 401 when status = 'REVOKED' then 403 when role = 'ADMIN' then 200 else 403 end::bigint admin_code,
      case when u.uid is null then 401 when status = 'REVOKED' then 403 when role in ('ADMIN', 'VIDEO_EDITOR') then 200 else 403 end::bigint editor_code,
      case when u.uid is null then 401 when status = 'REVOKED' then 403 else 200 end::bigint searcher_code
    from calls c left join users u using (uid)""",
)
def p13(spark, d):
    calls = table(spark, d, "orders").select("o_orderkey", F.floor(F.col("o_custkey") * 3 / 2).alias("uid"))
    out = reports.access_audit(calls, V.users(spark, d))
    return longs(out.select("o_orderkey", "uid", "admin_code", "editor_code", "searcher_code"), "admin_code", "editor_code", "searcher_code")


@query(
    "p15_p16_ids_and_paths",
    r"""with stored as (select page_id, url, 'media/' || regexp_replace(url, '^[a-z]+://', '') path from pages)
    select page_id, regexp_full_match(url, '[A-Za-z0-9._-]+') valid_id, not regexp_matches(url, '^([/\\]|[A-Za-z]:)') and not regexp_matches(url, '(^|[/\\])\.\.([/\\]|$)') and url <> '' url_contained,
      not regexp_matches(path, '^([/\\]|[A-Za-z]:)') and not regexp_matches(path, '(^|[/\\])\.\.([/\\]|$)') and path <> '' path_contained
    from stored""",
)
def p1516(spark, d):
    url = F.col("url")
    path = F.concat(F.lit("media/"), F.regexp_replace(url, r"^[a-z]+://", ""))
    return table(spark, d, "pages").select(
        "page_id", filters.valid_id(url).alias("valid_id"), filters.path_contained(url).alias("url_contained"),
        filters.path_contained(path).alias("path_contained"),
    )


# --- scans, sorting, paging ---------------------------------------------------------


@query("s2_vector_scan", f"with {S.FRAMES} select frame_id, video_id, len(embedding)::bigint dim, round(sqrt(list_dot_product(embedding, embedding)), 5) norm from frames")
def s2(spark, d):
    from kairoscope.functions.vectors import norm

    return longs(V.vectors(spark, d).select("frame_id", "video_id", F.size("embedding").alias("dim"), F.round(norm(F.col("embedding")), 5).alias("norm")), "dim")


@query("s3_media_files")
def s3(spark, d):
    return tables.list_media_files(spark, d).select("filename", "size_bytes", "extension", "media_kind", "accepted")


@query("s4_point_lookup", f"with {LIBRARY} select {ITEM} from library where video_id = 777")
def s4(spark, d):
    return _items(tables.lookup(V.library(spark, d), "video_id", 777))


_ORDERS = {
    "uploaded_at": "uploaded_at desc, video_id desc",
    "original_filename": "filename desc, video_id desc",
    "size_bytes": "size_bytes desc, video_id desc",
}
for _by, _order in _ORDERS.items():

    @query(
        f"o2_library_sort_{_by}",
        f"with {LIBRARY} select {ITEM} from library where contains(filename, 'low') order by {_order} limit 60",
    )
    def o2(spark, d, by=_by):
        p = reports.LibraryRequest(search="low", sort_by=by, page_size=60)
        return _items(reports.library_report(V.library(spark, d), p))


@query("o4_recent_jobs", "select event_id, user_id job_id from events order by ts desc, event_id desc limit 50")
def o4(spark, d):
    jobs = V.job_log(spark, d)
    return jobs.orderBy(F.desc("ts"), F.desc("event_id")).limit(reports.RECENT["jobs"]).select("event_id", "job_id")


@query("o5_offset_page", f"with {LIBRARY} select {ITEM} from library order by uploaded_at desc, video_id desc limit 25 offset 50")
def o5(spark, d):
    order = [F.desc("uploaded_at"), F.desc("video_id")]
    return _items(audit.page(V.library(spark, d), order, 3, 25))


@query(
    "o6_keyset_page",
    f"""with {LIBRARY} select {ITEM} from library where (uploaded_at, video_id) < (timestamp '1998-01-01', 500)
    order by uploaded_at desc, video_id desc limit 40""",
)
def o6(spark, d):
    import datetime

    last = (datetime.datetime(1998, 1, 1), 500)
    return _items(audit.keyset_page(V.library(spark, d), "uploaded_at", "video_id", last, 40))


@query(
    "s1_library_page",
    f"""with {LIBRARY}, f as (select * from library where contains(filename, 'urgent'))
    select video_id, {S.bytes_text('size_bytes')} size_text, {S.hms('duration_seconds')} duration_hms, (select count(*) from f) total
    from f order by uploaded_at desc, video_id desc limit 20 offset 20""",
)
def s1(spark, d):
    p = reports.LibraryRequest(search="urgent", page=2, page_size=20)
    return reports.library_report(V.library(spark, d), p).select("video_id", "size_text", "duration_hms", "total")


# --- joins and sets ------------------------------------------------------------------


@query(
    "j2_media_latest_job",
    """select c_custkey video_id, coalesce(j.o_orderkey, -1) job_id, coalesce(j.o_orderstatus, 'none') status
    from customer left join (select * from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1) j
      on j.o_custkey = c_custkey""",
)
def j2(spark, d):
    jobs = table(spark, d, "orders").select(
        F.col("o_custkey").alias("video_id"), F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("status"), "o_orderdate"
    )
    latest = temporal.latest_per_key(jobs, ["video_id"], ["o_orderdate", "job_id"]).drop("o_orderdate")
    media = table(spark, d, "customer").select(F.col("c_custkey").alias("video_id"))
    return media.join(latest, "video_id", "left").fillna(-1, ["job_id"]).fillna("none", ["status"])


@query("w3_latest_job", "select user_id job_id, event_id, event_type from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def w3(spark, d):
    log = table(spark, d, "events").select(F.col("user_id").alias("job_id"), "event_id", "event_type", "ts")
    return temporal.latest_per_key(log, ["job_id"], ["ts", "event_id"]).drop("ts")


@query("j4_u3_missing_keys", "select doc_id from documents where doc_id not in (select doc_id from labels)")
def j4(spark, d):
    return audit.missing_from(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@query(
    "j5_reconciliation",
    """select coalesce(a.doc_id, b.doc_id, c.item_id) as key, a.doc_id is not null in_catalog, b.doc_id is not null in_vectors, c.item_id is not null in_files,
      not (a.doc_id is not null and b.doc_id is not null and c.item_id is not null) reconciliation_required
    from documents a full join labels b on a.doc_id = b.doc_id full join benchmark c on c.item_id = coalesce(a.doc_id, b.doc_id)""",
)
def j5(spark, d):
    files = table(spark, d, "benchmark").withColumnRenamed("item_id", "doc_id")
    return audit.reconcile_keys(
        {"catalog": table(spark, d, "documents"), "vectors": table(spark, d, "labels"), "files": files}, "doc_id"
    )


# --- sinks ---------------------------------------------------------------------------


@query("s10_append_history", "select event_type mode, count(*) n, round(sum(value), 4) total_ms from events group by event_type")
def s10(spark, d):
    rows, path = V.history(spark, d), new_path(spark, "history")
    sinks.append(rows, path)
    back = spark.read.schema(rows.schema).parquet(path)
    return back.groupBy("mode").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("latency_ms"), 4).alias("total_ms"))


@query(
    "s11_upsert_users",
    f"""with {USERS}, latest as (
      select o_custkey * 2 uid, 'user' || o_orderkey || '@example.net' email, case o_orderstatus when 'F' then 'ADMIN' else 'SEARCHER' end as role, 'ACTIVE' status
      from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1)
    select coalesce(u.uid, l.uid) uid, coalesce(u.email, l.email) email, coalesce(l.role, u.role) as role, coalesce(l.status, u.status) status
    from users u full join latest l on u.uid = l.uid""",
)
def s11(spark, d):
    incoming = table(spark, d, "orders").select(
        (F.col("o_custkey") * 2).alias("uid"),
        F.concat(F.lit("user"), F.col("o_orderkey").cast("string"), F.lit("@example.net")).alias("email"),
        F.when(F.col("o_orderstatus") == "F", "ADMIN").otherwise("SEARCHER").alias("role"),
        F.lit("ACTIVE").alias("status"), "o_orderdate", "o_orderkey",
    )
    return sinks.upsert(V.users(spark, d), incoming, "uid", ["role", "status"], ["o_orderdate", "o_orderkey"])


@query(
    "s12_cascade_delete",
    """with doomed as (select doc_id from labels where toxic = 1)
    select 'documents' as "table", count(*) filter (doc_id in (select doc_id from doomed)) deleted, count(*) filter (doc_id not in (select doc_id from doomed)) kept from documents
    union all select 'labels', count(*) filter (toxic = 1), count(*) filter (toxic <> 1) from labels""",
)
def s12(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    _, counts = sinks.cascade_delete({"documents": docs, "labels": labels}, labels.filter("toxic = 1"), "doc_id")
    return counts


@query("s12_remaining_rows", "select doc_id, source from documents where doc_id not in (select doc_id from labels where toxic = 1)")
def s12b(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    remaining, _ = sinks.cascade_delete({"documents": docs}, labels.filter("toxic = 1"), "doc_id")
    return remaining["documents"].select("doc_id", "source")


@query("s13_delete_counts", "select 'one' scope, count(*) filter (event_id = 5) deleted from events union all select 'all', count(*) from events")
def s13(spark, d):
    rows = V.history(spark, d)
    _, one = sinks.delete_rows(rows, F.col("id") == 5)
    _, every = sinks.delete_rows(rows, F.lit(True))
    return one.select(F.lit("one").alias("scope"), "deleted").unionByName(every.select(F.lit("all").alias("scope"), "deleted"))


# --- display text --------------------------------------------------------------------

PRICE = "o_totalprice"


@query(
    "f1_f4_bytes_and_speed",
    f"""select o_orderkey, {S.bytes_text('(o_totalprice - 1000)')} small, {S.bytes_text('(o_totalprice * 7000)')} large,
      {S.bytes_text('(o_totalprice * o_totalprice * 50000)')} huge, case when o_totalprice <= 50000 then '—' else {S.bytes_text('(o_totalprice / 40000)')} || '/s' end speed
    from orders""",
)
def f1(spark, d):
    p = F.col(PRICE)
    speed = F.when(p <= 50000, 0.0).otherwise(p / 40000)
    return table(spark, d, "orders").select(
        "o_orderkey", X.format_bytes(p - 1000).alias("small"), X.format_bytes(p * 7000).alias("large"),
        X.format_bytes(p * p * 50000).alias("huge"), X.format_speed(speed).alias("speed"),
    )


@query(
    "f2_f3_f5_clock_text",
    f"""select o_orderkey, {S.hms('(o_totalprice / 40)')} hms, {S.hms('(o_totalprice / 2000 - 10)')} short_hms, {S.eta('(o_totalprice / 40 - 100)')} eta, {S.eta('(o_totalprice / 4000)')} short_eta,
      floor(o_totalprice / 4000 + 0.5)::bigint || '%' pct, {S.fixed('(o_totalprice / 500000 * 100)', 1)} || '% match' match_text
    from orders""",
)
def f2(spark, d):
    p = F.col(PRICE)
    return table(spark, d, "orders").select(
        "o_orderkey", X.format_hms(p / 40).alias("hms"), X.format_hms(p / 2000 - 10).alias("short_hms"),
        X.format_eta(p / 40 - 100).alias("eta"), X.format_eta(p / 4000).alias("short_eta"),
        X.format_percent(p / 4000).alias("pct"), X.match_percent(p / 500000).alias("match_text"),
    )


@query(
    "f6_title_case",
    """select o_orderkey, case o_orderpriority when '1-URGENT' then '1-Urgent' when '2-HIGH' then '2-High' when '3-MEDIUM' then '3-Medium'
      when '4-NOT SPECIFIED' then '4-Not Specified' else '5-Low' end stage from orders""",
)
def f6(spark, d):
    raw = F.replace(F.lower("o_orderpriority"), F.lit(" "), F.lit("_"))
    return table(spark, d, "orders").select("o_orderkey", X.title_case(raw).alias("stage"))


@query(
    "f7_f17_dates",
    """select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') iso, strftime(date '2000-01-31' - 30, '%Y-%m-%d') month_ago, strftime(o_orderdate, '%b %-d, %Y') shown,
      strftime(o_orderdate + to_minutes(o_custkey % 1440), '%b %-d, %Y, %I:%M %p') shown_time, o_orderpriority not_a_date from orders""",
)
def f7(spark, d):
    when = F.col("o_orderdate").cast("timestamp")
    late = F.timestamp_seconds(F.unix_seconds(when) + F.pmod(F.col("o_custkey"), F.lit(1440)) * 60)
    return table(spark, d, "orders").select(
        "o_orderkey", X.to_iso_date(when).alias("iso"), X.days_ago(F.lit("2000-01-31"), 30).alias("month_ago"),
        X.format_date(when.cast("string")).alias("shown"), X.format_date_time(late.cast("string")).alias("shown_time"),
        X.format_date(F.col("o_orderpriority")).alias("not_a_date"),
    )


@query(
    "f8_safe_file_name",
    r"""select page_id, case when left(regexp_replace(regexp_replace(url, '\.[^.]+$', ''), '[^A-Za-z0-9._-]+', '_', 'g'), 80) = '' then 'export'
      else left(regexp_replace(regexp_replace(url, '\.[^.]+$', ''), '[^A-Za-z0-9._-]+', '_', 'g'), 80) end safe_name from pages""",
)
def f8(spark, d):
    return table(spark, d, "pages").select("page_id", X.safe_file_name(X.strip_extension(F.col("url"))).alias("safe_name"))


@query("f9_csv_escape", f"select doc_id, {S.csv('text')} cell from documents")
def f9(spark, d):
    return table(spark, d, "documents").select("doc_id", X.csv_escape(F.col("text")).alias("cell"))


@query(
    "f12_to_fixed",
    f"select o_orderkey, {S.fixed('(o_totalprice / 1000)', 2)} two, {S.fixed('(o_totalprice / 7 - 30000)', 1)} one, {S.number('o_totalprice')} plain from orders",
)
def f12(spark, d):
    p = F.col(PRICE)
    return table(spark, d, "orders").select(
        "o_orderkey", X.to_fixed(p / 1000, 2).alias("two"), X.to_fixed(p / 7 - 30000, 1).alias("one"), X.js_number(p).alias("plain")
    )


@query(
    "f15_first_frames",
    f"""with {S.FRAMES} select video_id, count(*) n_frames, max(ts) last_s, string_agg(frame_id, ',' order by ts, frame_id) filter (r <= 60) shown
    from (select *, row_number() over (partition by video_id order by ts, frame_id) r from frames) group by video_id""",
)
def f15(spark, d):
    return reports.first_frames(V.vectors(spark, d), 60).select(
        "video_id", "n_frames", "last_s", F.array_join(F.transform("frames", lambda f: f["frame_id"]), ",").alias("shown")
    )


@query(
    "f16_history_filters",
    """select id, top_k, mode from (select event_id id, (props->>'$.k')::bigint top_k, event_type mode from events)""",
)
def f16(spark, d):
    parsed = reports.parse_filters(
        V.history(spark, d).withColumn("filters", F.replace("filters", F.lit('"k"'), F.lit('"top_k"')))
    )
    return longs(parsed.select("id", F.col("request.top_k").alias("top_k"), "mode"), "top_k")


@query(
    "f18_math",
    """select o_orderkey, abs(o_totalprice - 250000) a, floor(o_totalprice)::bigint f, ceil(o_totalprice)::bigint c, round(sqrt(o_totalprice), 6) r,
      greatest(o_orderkey, o_custkey) hi, least(o_orderkey, o_custkey) lo, o_orderkey % 60 m, bit_count(xor(o_orderkey, o_custkey))::bigint bits from orders""",
)
def f18(spark, d):
    p = F.col(PRICE)
    return table(spark, d, "orders").select(
        "o_orderkey", F.abs(p - 250000).alias("a"), F.floor(p).alias("f"), F.ceil(p).alias("c"), F.round(F.sqrt(p), 6).alias("r"),
        F.greatest("o_orderkey", "o_custkey").alias("hi"), F.least("o_orderkey", "o_custkey").alias("lo"),
        (F.col("o_orderkey") % 60).alias("m"), temporal.hamming(F.col("o_orderkey"), F.col("o_custkey")).cast("long").alias("bits"),
    )
