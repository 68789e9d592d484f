"""Retrieval, ranking and moment queries."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kairoscope.functions import text as X
from kairoscope.functions.vectors import cosine_pairs, embed_text, mean_vector
from kairoscope.operators import context, evaluate, filters, ranking, retrieval, temporal
from kairoscope.plans import search
from kairoscope.schemas import RerankWeights, SearchParams
from kairoscope.sources.tables import scan_index, write_vectors
from kairoscope.staging import new_path, stage

from . import sql as S
from . import views as V
from .registry import query
from .views import longs, rounded, table

P = SearchParams()


def _text_vectors(spark, d, expand=False):
    return search.query_vectors(V.text_queries(spark, d), V.DIM, expand)


def _prototypes(spark, d):
    clips = V.vectors(spark, d).filter(F.col("media_type") == "video")
    return mean_vector(clips.select(F.col("video_id").alias("query_id"), "embedding"), ["query_id"])


def _hits(spark, d, **kw):
    return retrieval.top_k(V.vectors(spark, d), _text_vectors(spark, d), P.top_k, **kw)


def _moments(spark, d, n=1):
    return temporal.representatives(temporal.group_events(_hits(spark, d), P.group_window_s), n)


HITS = f"with {S.MEDIA}, {S.QVEC}, {S.hits('qvec')}"
REPS = f"{HITS}, {S.events()}, {S.reps()}"
HIT_COLUMNS = "query_id, frame_id, video_id, rank::bigint rank, round(raw, 6) raw_similarity, round(score, 6) score"


def _hit_columns(df):
    return rounded(
        longs(df.select("query_id", "frame_id", "video_id", "rank", "raw_similarity", "score"), "rank"),
        "raw_similarity", "score",
    )


@query(
    "v1_cosine",
    f"""with {S.FRAMES}, {S.PROTOTYPES.replace(" where media_type = 'video'", "")}
    select f.frame_id, f.video_id, round({S.cos('f.embedding', 'p.embedding')}, 6) cosine
    from frames f join proto p on p.query_id = f.video_id""",
)
def v1(spark, d):
    frames = V.vectors(spark, d)
    proto = mean_vector(frames.select(F.col("video_id").alias("query_id"), "embedding"), ["query_id"])
    joined = frames.join(proto.select(F.col("query_id").alias("video_id"), F.col("embedding").alias("_p")), "video_id")
    return rounded(joined.select("frame_id", "video_id", cosine_pairs("embedding", "_p").alias("cosine")), "cosine")


@query("v2_top_k", f"{HITS} select {HIT_COLUMNS} from hits")
def v2(spark, d):
    return _hit_columns(_hits(spark, d))


@query("v3_batched_queries", f"with {S.FRAMES}, {S.PROTOTYPES}, {S.hits('proto', 20)} select {HIT_COLUMNS} from hits")
def v3(spark, d):
    return _hit_columns(retrieval.top_k(V.vectors(spark, d), _prototypes(spark, d), 20))


def _coded(spark, d, vectors):
    book, path = retrieval.fit_codebook(vectors, 16), new_path(spark, "coded")
    write_vectors(retrieval.index_vectors(vectors, book), path)
    return scan_index(spark, path), book


@query("v4_approximate_top_k", f"{HITS} select {HIT_COLUMNS} from hits")
def v4(spark, d):
    """With every cell probed and enough candidates by code the exact hits are found."""
    index, book = _coded(spark, d, V.vectors(spark, d))
    return _hit_columns(retrieval.approx_top_k(index, _text_vectors(spark, d), book, P.top_k, n_probe=16, rescore=16))


# The share of the exact best 50 that a search of fourteen of sixteen cells must find;
# the given vectors have no clusters, so few cells do not hold them.
RECALL = 0.9


@query("v4_recall", f"with {S.FRAMES}, {S.QVEC} select count(*) * least(50, (select count(*) from frames))::bigint wanted, true enough from qvec")
def v4_recall(spark, d):
    vectors, queries = V.vectors(spark, d), _text_vectors(spark, d)
    index, book = _coded(spark, d, vectors)
    found = retrieval.approx_top_k(index, queries, book, P.top_k, n_probe=14)
    exact = retrieval.top_k(vectors, queries, P.top_k).select("query_id", "frame_id")
    both = exact.join(found.select("query_id", "frame_id", F.lit(1).alias("found")), ["query_id", "frame_id"], "left")
    return both.agg(F.count(F.lit(1)).alias("wanted"), (F.count("found") >= RECALL * F.count(F.lit(1))).alias("enough"))


@query(
    "v5_stamp_report",
    f"""with {S.FRAMES} select 64::bigint dim, 'given-vectors' model, 'r1' model_revision, 'p1' preprocessing_version,
      case media_type when 'image' then 'i0' else 'i1' end indexing_version, count(*) n_vectors, media_type = 'video' compatible
    from frames group by media_type""",
)
def v5(spark, d):
    return longs(ranking.stamp_report(V.stamped(spark, d), V.STAMPS), "dim")


@query(
    "v5_compatible_vectors",
    f"with {S.FRAMES} select video_id, count(*) n from frames where media_type = 'video' group by video_id",
)
def v5b(spark, d):
    kept = ranking.require_compatible(V.stamped(spark, d), V.STAMPS, allow_mismatch=True)
    return kept.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "v6_text_embedding",
    f"""with docs as (select doc_id, text from documents), {S.embedded('docs', 'doc_id', 'text', 'e')}
    select doc_id, list_aggregate(list_transform(embedding,
        lambda x: case when n > 0 then round(x / sqrt(n) * 1000000)::bigint else 0 end::varchar), 'string_agg', ',') vector
    from (select *, list_sum(list_transform(embedding, lambda x: x * x)) n from e)""",
)
def v6(spark, d):
    docs = embed_text(table(spark, d, "documents").select("doc_id", "text"), "text", V.DIM)
    units = F.transform("embedding", lambda x: F.round(x * 1000000).cast("long").cast("string"))
    return docs.select("doc_id", F.array_join(units, ",").alias("vector"))


def _projection_model():
    """Stand-in for a real model: a fixed 64 -> 16 cosine projection."""
    i, j = np.arange(V.DIM), np.arange(16)
    weights = np.cos(np.pi / V.DIM * (i[:, None] + 0.5) * j[None, :])

    def predict(x: np.ndarray) -> np.ndarray:
        return x.astype(np.float64) @ weights

    return predict


@query(
    "v7_batch_embedding",
    f"""with {S.FRAMES} select frame_id, list_aggregate(list_transform(range(16), lambda j: round(list_sum(list_transform(
        range(64), lambda i: embedding[i + 1] * cos(pi() / 64 * (i + 0.5::double) * j))), 4)::decimal(18, 4)::varchar), 'string_agg', ',') embedded
    from frames""",
)
def v7(spark, d):
    embed = predict_batch_udf(
        _projection_model, return_type=T.ArrayType(T.DoubleType()), batch_size=512, input_tensor_shapes=[[V.DIM]]
    )
    out = V.vectors(spark, d).select("frame_id", embed("embedding").alias("_e"))
    shown = F.transform("_e", lambda x: F.round(x, 4).cast("decimal(18,4)").cast("string"))
    return out.select("frame_id", F.array_join(shown, ",").alias("embedded"))


@query("v8_query_expansion", f"with {S.COMPONENTS} select query_id, component::bigint component, component_text from components")
def v8(spark, d):
    expanded = ranking.expand_queries(ranking.guard_queries(V.text_queries(spark, d)))
    return longs(expanded.select("query_id", "component", "component_text"), "component")


for _method in ("max", "sum"):

    @query(
        f"v9_fused_{_method}",
        f"""with {S.FRAMES}, {S.CVEC}, {S.fused(_method)}
        select {HIT_COLUMNS}, component::bigint matched_component from hits""",
    )
    def v9(spark, d, method=_method):
        hits = retrieval.top_k(V.vectors(spark, d), _text_vectors(spark, d, True), P.top_k, method=method, boost=1.2)
        return _hit_columns(hits).join(longs(hits.select("query_id", "frame_id", "matched_component"), "matched_component"), ["query_id", "frame_id"])


@query(
    "v10_minmax",
    f"""{HITS} select query_id, frame_id, round(case when hi > lo then (score - lo) / (hi - lo) else 1 end, 6) similarity
    from (select *, min(score) over (partition by query_id) lo, max(score) over (partition by query_id) hi from hits)""",
)
def v10(spark, d):
    return rounded(ranking.normalize(_hits(spark, d), "minmax").select("query_id", "frame_id", "similarity"), "similarity")


@query(
    "v11_rerank",
    f"""with {S.FRAMES}, {S.CVEC}, {S.fused('max')}, {S.events()}, {S.reps()}, {S.reranked(neighbour=0.05, duplicate=0.01)}
    select query_id, frame_id, rank::bigint as rank, round(final_score, 6) final_score, row_in_video::bigint row_in_video, neighbours::bigint neighbours
    from ranked""",
)
def v11(spark, d):
    hits = retrieval.top_k(V.vectors(spark, d), _text_vectors(spark, d, True), P.top_k)
    reps = temporal.representatives(temporal.group_events(hits, P.group_window_s))
    weights = RerankWeights(neighbour=0.05, duplicate=0.01)
    ranked = ranking.rerank(ranking.normalize(reps), weights)
    ranked = ranked.select("query_id", "frame_id", "rank", "final_score", "row_in_video", "neighbours")
    return rounded(longs(ranked, "rank", "row_in_video", "neighbours"), "final_score")


@query(
    "v12_external_permutation",
    f"""{HITS}, supplied as (
      select h.query_id, h.frame_id,
        case when contains(q.query, 'with') then row_number() over (partition by h.query_id order by h.ts, h.frame_id)
             else dense_rank() over (partition by h.query_id order by h.video_id) end new_rank
      from hits h join queries q using (query_id) where contains(lower(q.query), 'the')),
    offered as (select query_id, count(*) n, count(distinct frame_id) nf, count(distinct new_rank) nr, min(new_rank) lo, max(new_rank) hi
      from supplied group by query_id),
    checked as (select h.*, s.new_rank, case when o.n is null then 'unavailable'
        when o.nr = o.n and o.nf = o.n and o.lo = 1 and o.hi = o.n and o.n = count(*) over (partition by h.query_id) then 'applied' else 'skipped' end rerank
      from hits h left join supplied s using (query_id, frame_id) left join offered o using (query_id))
    select query_id, frame_id, rerank, (case rerank when 'applied' then new_rank else rank end)::bigint final_rank from checked""",
)
def v12(spark, d):
    from pyspark.sql import Window

    hits = stage(_hits(spark, d), "hits")
    texts = V.text_queries(spark, d)
    offered = hits.join(texts, "query_id").filter(F.lower("query").contains("the"))
    w = Window.partitionBy("query_id")
    new_rank = F.when(
        F.col("query").contains("with"), F.row_number().over(w.orderBy("timestamp", "frame_id"))
    ).otherwise(F.dense_rank().over(w.orderBy("video_id")))
    supplied = offered.select("query_id", "frame_id", new_rank.alias("new_rank"))
    out = ranking.accept_permutation(hits, supplied).select("query_id", "frame_id", "rerank", "final_rank")
    return longs(out, "final_rank")


# Coarse index: every frame by the first half of its vector; the fine index holds the whole vectors.
COARSE = f"""coarse as (select * replace (list_transform(embedding, lambda x, i: case when i <= {V.DIM // 2} then x else 0.0 end) as embedding) from frames)"""
BOUNDED = """visited as (
  select *, event_rank * 16.0 seconds_used from (
    select *, row_number() over (partition by query_id order by score desc, frame_id) event_rank,
      sum(event_hits) over (partition by query_id order by score desc, frame_id rows unbounded preceding) frames_used from reps)
  where event_rank <= 10 and event_rank * 16.0 <= 160 and frames_used <= 20)"""


def _coarse(spark, d):
    half = F.transform("embedding", lambda x, i: F.when(i < V.DIM // 2, x).otherwise(F.lit(0.0).cast("float")))
    return V.vectors(spark, d).withColumn("embedding", half)


def _coarse_events(spark, d):
    hits = retrieval.top_k(_coarse(spark, d), _text_vectors(spark, d), P.top_k)
    return temporal.representatives(temporal.group_events(hits, P.group_window_s))


COARSE_REPS = f"with {S.FRAMES}, {COARSE}, {S.QVEC}, {S.hits('qvec', frames='coarse')}, {S.events()}, {S.reps()}, {BOUNDED}"


@query(
    "v13_fine_merge",
    f"""{COARSE_REPS}, fine as (
      select v.query_id, v.video_id, v.event_index, f.frame_id, f.ts,
        {S.cos('f.embedding', 'q.embedding')} raw, round((1 + {S.cos('f.embedding', 'q.embedding')}) / 2, 12) score
      from visited v join frames f on f.video_id = v.video_id and f.ts between v.ts - 8 and v.ts + 8 join qvec q using (query_id)),
    best as (select * from fine qualify row_number() over (partition by query_id, video_id, event_index order by score desc, ts, frame_id) = 1)
    select r.query_id, r.video_id, r.event_index, case when b.score > r.score then b.frame_id else r.frame_id end frame_id,
      round(case when b.score > r.score then b.ts else r.ts end, 6) "timestamp", round(case when b.score > r.score then b.score else r.score end, 6) score,
      case when b.score > r.score then 'fine' else 'coarse' end retrieval_stage
    from reps r left join best b using (query_id, video_id, event_index)""",
)
def v13(spark, d):
    p = SearchParams(fine_max_frames=20)
    events = stage(_coarse_events(spark, d), "events")
    fine = search.fine_candidates(events, V.vectors(spark, d), _text_vectors(spark, d), p)
    merged = ranking.merge_fine(events, fine)
    out = merged.select("query_id", "video_id", "event_index", "frame_id", "timestamp", "score", "retrieval_stage")
    return rounded(longs(out, "event_index"), "timestamp", "score")


@query("v14_fine_bounds", f"{COARSE_REPS} select query_id, frame_id, event_rank::bigint event_rank, frames_used::bigint frames_used from visited")
def v14(spark, d):
    events = _coarse_events(spark, d).withColumn("span_s", F.lit(16.0)).withColumn("n_frames", F.col("event_hits"))
    out = ranking.bound_events(events, 10, 160.0, 20).select("query_id", "frame_id", "event_rank", "frames_used")
    return longs(out, "event_rank", "frames_used")


@query(
    "v15_trace",
    f"""{REPS} select query_id, 'coarse' retrieval_stage, frame_id, printf('%.6f', score) score, printf('%.6f', raw) raw_cosine,
      event_index::varchar group_event_index, 'given-vectors' embedding_model, 'r1' model_version, 'i1' indexing_version from reps""",
)
def v15(spark, d):
    stamps = {"embedding_model": V.STAMPS["model"], "model_version": "r1", "indexing_version": "i1"}
    traced = ranking.with_trace(_moments(spark, d).withColumn("retrieval_stage", F.lit("coarse")), stamps)
    names = ("retrieval_stage", "frame_id", "score", "raw_cosine", "group_event_index", *stamps)
    return traced.select("query_id", *[F.col("trace")[n].alias(n) for n in names])


def _results(spark, d, mode, p=P, **kw):
    vectors = V.vectors(spark, d).withColumns({name: F.lit(value) for name, value in V.STAMPS.items()})
    return search.search_moments(vectors, V.text_queries(spark, d), V.media(spark, d), p, mode, dim=V.DIM, stamps=V.STAMPS, **kw)


FAST = f"{REPS}, top as (select * from (select * exclude (rank), row_number() over (partition by query_id order by score desc, frame_id) as rank from reps) where rank <= 5)"


def _result_sql(ranked: str, final: str) -> str:
    return f"""joined as (
      select r.*, q.query, m.filename, m.duration, m.uploaded_at from {ranked} r join queries q using (query_id) join media m using (video_id)),
    {S.context('joined')}, shaped as (
      select j.*, c.n_frames, c.frame_list, c.shown, c.shown_lines, (1 + raw) / 2 sim, {final} final_score_out,
        case j.media_type when 'video' then c.context_start end cs, case j.media_type when 'video' then c.context_end end ce,
        'Matched frame ' || frame_id || ' with raw cosine ' || {S.fixed('raw', 4)} || '; ' || c.n_frames || ' context frame(s) in the segment.' reason
      from joined j join ctx c using (query_id, frame_id))"""


SHAPED_FAST = FAST + ", " + _result_sql("top", "score")
ACCURATE = f"with {S.MEDIA}, {S.CVEC}, {S.fused('max')}, {S.events()}, {S.reps()}, {S.reranked()}, top as (select * from ranked where rank <= 5)"
SHAPED = ACCURATE + ", " + _result_sql("top", "final_score")
RESULT_SQL = f"""select query_id, rank::bigint as rank, frame_id, video_id, filename video_name, media_type, {S.hms('ts')} timestamp_hms,
  round(sim, 6) similarity, round(raw, 6) raw_similarity, round(final_score_out, 6) final_score, coalesce({S.hms('duration')}, '—') duration_text,
  strftime(uploaded_at, '%Y-%m-%d') uploaded, frame_list, coalesce(round(cs, 6), -1) context_start, coalesce(round(ce, 6), -1) context_end, reason
from shaped"""


def _result_view(df):
    shown = df.select(
        "query_id", "rank", "frame_id", "video_id", "video_name", "media_type", "timestamp_hms", "similarity",
        "raw_similarity", "final_score", X.format_hms(F.col("duration")).alias("duration_text"),
        X.to_iso_date(F.col("uploaded_at")).alias("uploaded"),
        F.array_join(F.transform("context_frames", lambda f: f["frame_id"]), ",").alias("frame_list"),
        F.coalesce("context_start", F.lit(-1.0)).alias("context_start"),
        F.coalesce("context_end", F.lit(-1.0)).alias("context_end"),
        F.col("context_reason").alias("reason"),
    )
    return rounded(longs(shown, "rank"), "similarity", "raw_similarity", "final_score", "context_start", "context_end")


@query("v16_fast_mode", f"{SHAPED_FAST} {RESULT_SQL}")
def v16_fast(spark, d):
    return _result_view(_results(spark, d, "fast"))


@query("v16_accurate_mode", f"{SHAPED} {RESULT_SQL}")
def v16_accurate(spark, d):
    return _result_view(_results(spark, d, "accurate"))


# Accurate mode in full: coarse and fine vectors, rerank, and an external permutation of the shortlist.
FINE = f"""qfull as (select query_id, embedding from cvec where component = 0), fine as (
      select v.query_id, v.video_id, v.event_index, f.frame_id, f.ts, {S.cos('f.embedding', 'q.embedding')} raw,
        round((1 + {S.cos('f.embedding', 'q.embedding')}) / 2, 12) score
      from visited v join frames f on f.video_id = v.video_id and f.ts between v.ts - 8 and v.ts + 8 join qfull q using (query_id)),
    best as (select * from fine qualify row_number() over (partition by query_id, video_id, event_index order by score desc, ts, frame_id) = 1),
    merged as (
      select r.* replace (if(b.score > r.score, b.frame_id, r.frame_id) as frame_id, if(b.score > r.score, b.ts, r.ts) as ts,
          if(b.score > r.score, b.raw, r.raw) as raw, if(b.score > r.score, b.score, r.score) as score),
        if(b.score > r.score, 'fine', 'coarse') retrieval_stage
      from reps r left join best b using (query_id, video_id, event_index)
      qualify row_number() over (partition by r.query_id, if(b.score > r.score, b.frame_id, r.frame_id) order by r.event_index) = 1)"""
PERMUTED = """offered as (
      select query_id, frame_id, case when contains(query, 'with') then row_number() over (partition by query_id order by ts, frame_id)
        else dense_rank() over (partition by query_id order by video_id) end new_rank
      from ranked join queries using (query_id) where contains(lower(query), 'the')),
    verdict as (
      select query_id, if(count(distinct new_rank) = count(*) and max(new_rank) = count(*), 'applied', 'skipped') rerank from offered group by query_id),
    top as (select * from (
      select r.* exclude (rank), coalesce(rerank, 'unavailable') rerank,
        row_number() over (partition by query_id order by if(rerank = 'applied', new_rank, rank), frame_id) as rank
      from ranked r left join verdict using (query_id) left join offered using (query_id, frame_id)) where rank <= 5)"""
FULL = f"""with {S.MEDIA}, {COARSE}, {S.CVEC}, {S.fused('max', frames='coarse')}, {S.events()}, {S.reps()}, {BOUNDED}, {FINE},
    {S.reranked('merged')}, {PERMUTED}, {_result_sql('top', 'final_score')}"""


def _offer(spark, d):
    """A stand-in for an external reranker: by time for some queries, no permutation for others, nothing for the rest."""
    texts = V.text_queries(spark, d)

    def answer(shortlist):
        from pyspark.sql import Window

        w = Window.partitionBy("query_id")
        by_time = F.row_number().over(w.orderBy("timestamp", "frame_id"))
        by_video = F.dense_rank().over(w.orderBy("video_id"))
        asked = shortlist.join(texts, "query_id").filter(F.lower("query").contains("the"))
        return asked.select("query_id", "frame_id", F.when(F.col("query").contains("with"), by_time).otherwise(by_video).alias("new_rank"))

    return answer


@query("v16_accurate_reranked", f"{FULL} {RESULT_SQL.replace(' reason' + chr(10), ' reason, retrieval_stage, rerank' + chr(10))}")
def v16_reranked(spark, d):
    stamps = {name: F.lit(value) for name, value in V.STAMPS.items()}
    found = search.search_moments(
        _coarse(spark, d).withColumns(stamps), V.text_queries(spark, d), V.media(spark, d), SearchParams(fine_max_frames=20),
        "accurate", dim=V.DIM, stamps=V.STAMPS, fine_vectors=V.vectors(spark, d).withColumns(stamps), permutation=_offer(spark, d),
    )
    found = stage(found.withColumn("rerank", F.col("trace")["rerank"]), "results")
    extra = found.select("query_id", "frame_id", "retrieval_stage", "rerank")
    return _result_view(found).join(extra, ["query_id", "frame_id"])


@query(
    "v16_metadata_mode",
    f"with {S.MEDIA} select video_id, filename from media where contains(lower(filename), 'clip') and (contains(lower(filename), 'mp4') or media_type = 'mp4')",
)
def v16_metadata(spark, d):
    return search.search_metadata(V.media(spark, d), "Clip MP4", P).select("video_id", "filename")


@query(
    "p1_result_projection",
    f"{SHAPED} select query_id, frame_id, video_id, 640::bigint width, 360::bigint height, 'media/' || video_id stream_url, 'frames/' || video_id || '/' || frame_id || '.jpg' frame_url, 26::bigint n_fields from shaped",
)
def p1(spark, d):
    results = _results(spark, d, "accurate").withColumn("n_fields", F.lit(len(search.RESULT_COLUMNS)))
    return longs(results.select("query_id", "frame_id", "video_id", "width", "height", "stream_url", "frame_url", "n_fields"), "width", "height", "n_fields")


@query(
    "p8_min_similarity",
    f"with {S.FRAMES}, {S.QVEC}, {S.hits('qvec', where='score >= 0.55')} select {HIT_COLUMNS} from hits",
)
def p8(spark, d):
    return _hit_columns(_hits(spark, d, min_similarity=0.55))


@query(
    "p2_video_filter",
    f"with {S.FRAMES}, kept as (select * from frames where video_id in ('clip_1', 'clip_4')), {S.QVEC}, {S.hits('qvec', frames='kept')} select {HIT_COLUMNS} from hits",
)
def p2(spark, d):
    p = SearchParams(video_ids=("clip_1", "clip_4"))
    return _hit_columns(search.candidates(V.vectors(spark, d), _text_vectors(spark, d), None, p))


@query(
    "j3_filtered_retrieval",
    f"""with {S.MEDIA}, kept as (select * from frames where video_id in (select video_id from media where uploaded_at >= '2024-01-02' and uploaded_at < '2024-01-09')),
    {S.QVEC}, {S.hits('qvec', frames='kept')} select {HIT_COLUMNS} from hits""",
)
def j3(spark, d):
    p = SearchParams(date_from="2024-01-02", date_to="2024-01-08")
    return _hit_columns(search.candidates(V.vectors(spark, d), _text_vectors(spark, d), V.media(spark, d), p))


@query(
    "j1_frames_with_media",
    f"with {S.MEDIA} select f.frame_id, f.video_id, m.filename, m.frame_count, round(f.ts, 6) \"timestamp\" from frames f join media m using (video_id)",
)
def j1(spark, d):
    frames = V.vectors(spark, d).select("frame_id", "video_id", "timestamp")
    return rounded(frames.join(V.media(spark, d).select("video_id", "filename", "frame_count"), "video_id"), "timestamp")


NEAR = f"""{REPS}, near as (
  select r.query_id, r.frame_id, r.video_id, r.ts, f.frame_id near_frame_id, f.ts near_ts
  from reps r join frames f on f.video_id = r.video_id and f.ts between r.ts - 8 and r.ts + 8)"""


@query("j6_frames_near_match", f"{NEAR} select query_id, frame_id, near_frame_id, round(near_ts, 6) near_timestamp from near")
def j6(spark, d):
    frames = V.vectors(spark, d).select("frame_id", "video_id", "timestamp")
    near = temporal.frames_near(_moments(spark, d), frames, 8.0)
    return rounded(near.select("query_id", "frame_id", "near_frame_id", "near_timestamp"), "near_timestamp")


@query(
    "j9_nearest_frame",
    f"""{NEAR} select query_id, frame_id, near_frame_id, round(near_ts, 6) near_timestamp from near where near_frame_id <> frame_id
    qualify row_number() over (partition by query_id, frame_id order by abs(near_ts - ts), near_ts, near_frame_id) = 1""",
)
def j9(spark, d):
    frames = V.vectors(spark, d).select("frame_id", "video_id", "timestamp")
    best = temporal.nearest_frame(_moments(spark, d), frames, 8.0, ["query_id", "frame_id"])
    return rounded(best, "near_timestamp")


@query(
    "w1_event_grouping",
    f"{HITS}, {S.events()} select query_id, frame_id, video_id, event_index, round(ts, 6) \"timestamp\" from events",
)
def w1(spark, d):
    out = temporal.group_events(_hits(spark, d), P.group_window_s)
    return rounded(longs(out.select("query_id", "frame_id", "video_id", "event_index", "timestamp"), "event_index"), "timestamp")


@query(
    "w2_event_representatives",
    f"""{HITS}, {S.events()}, {S.reps(n=2)} select query_id, frame_id, event_index, row_in_event::bigint row_in_event,
      round(event_start, 6) event_start, round(event_end, 6) event_end, event_hits from reps""",
)
def w2(spark, d):
    out = _moments(spark, d, 2).select("query_id", "frame_id", "event_index", "row_in_event", "event_start", "event_end", "event_hits")
    return rounded(longs(out, "event_index", "row_in_event"), "event_start", "event_end")


@query(
    "w4_w5_neighbour_and_spread",
    f"""{HITS} select query_id, frame_id,
      count(*) over (partition by query_id, video_id order by round(ts * 1000000)::bigint range between 10000000 preceding and 10000000 following) - 1 neighbours,
      row_number() over (partition by query_id, video_id order by (1 + raw) / 2 desc, ts, frame_id)::bigint row_in_video from hits""",
)
def w45(spark, d):
    out = ranking.rerank(ranking.normalize(_hits(spark, d))).select("query_id", "frame_id", "neighbours", "row_in_video")
    return longs(out, "neighbours", "row_in_video")


@query(
    "w6_context_window",
    f"""{REPS} select query_id, frame_id, round(greatest(0.0::double, ts - 8), 6) low, round(least(coalesce(duration, ts + 8), ts + 8), 6) high
    from reps join media using (video_id)""",
)
def w6(spark, d):
    facts = V.media(spark, d).select("video_id", "duration_seconds")
    joined = _moments(spark, d).join(facts, "video_id")
    low, high = context.segment_window(F.col("timestamp"), F.col("duration_seconds"), 8.0)
    return rounded(joined.select("query_id", "frame_id", low.alias("low"), high.alias("high")), "low", "high")


@query(
    "w7_context_frames",
    f"""{REPS}, joined as (select r.*, m.duration from reps r join media m using (video_id)), {S.context('joined')}
    select query_id, frame_id, n_frames, frame_list, shown, round(context_start, 6) context_start, round(context_end, 6) context_end
    from ctx join joined using (query_id, frame_id) where media_type = 'video'""",
)
def w7(spark, d):
    facts = V.media(spark, d).select("video_id", F.col("duration_seconds").alias("duration"))
    moments = _moments(spark, d).join(facts, "video_id").filter(F.col("media_type") == "video")
    out = context.with_context(moments, V.vectors(spark, d))
    return rounded(
        out.select(
            "query_id", "frame_id", F.size("context_frames").cast("long").alias("n_frames"),
            F.array_join(F.transform("context_frames", lambda f: f["frame_id"]), ",").alias("frame_list"),
            F.array_join(F.transform("context_frames", lambda f: f["timestamp_hms"]), ", ").alias("shown"),
            "context_start", "context_end",
        ),
        "context_start", "context_end",
    )


for _sort, _expr in (("relevance", "final_score"), ("timestamp", "ts"), ("upload_date", "uploaded_at")):

    @query(
        f"o1_sort_{_sort}",
        f"""with {S.MEDIA}, {S.CVEC}, {S.fused('max')}, {S.events()}, {S.reps()}, {S.reranked()}
        select query_id, frame_id, row_number() over (partition by query_id order by {_expr} asc, frame_id) as rank
        from ranked join media using (video_id)""",
    )
    def o1(spark, d, sort=_sort):
        hits = retrieval.top_k(V.vectors(spark, d), _text_vectors(spark, d, True), P.top_k)
        reps = temporal.representatives(temporal.group_events(hits, P.group_window_s))
        scored = ranking.rerank(ranking.normalize(reps)).join(V.media(spark, d).select("video_id", "uploaded_at"), "video_id")
        return longs(ranking.order_results(scored, sort, "asc").select("query_id", "frame_id", "rank"), "rank")


@query(
    "w7_spread_context",
    f"""{REPS}, joined as (select r.*, m.duration from reps r join media m using (video_id)), {S.context('joined')}, {S.SIGNS},
    seen as (
      select query_id, c.frame_id, nf, nt, phash, nf = c.frame_id own, row_number() over (partition by query_id, c.frame_id order by nf <> c.frame_id, nt, nf) r
      from ctx_frames c join s on s.frame_id = nf::bigint),
    listed as (select query_id, frame_id, list([{{'h': phash, 'f': nf, 't': nt}}] order by r) l from seen group by query_id, frame_id),
    folded as (select query_id, frame_id, list_reduce(l, lambda kept, x: case when list_bool_or(list_transform(kept, lambda k: bit_count(xor(k.h, x[1].h)) <= 8)) then kept else list_concat(kept, x) end) kept from listed)
    select query_id, frame_id, n::bigint n_frames, frame_list from (
      select query_id, frame_id, count(*) n, string_agg(k.f, ',' order by k.t, k.f) frame_list
      from (select query_id, frame_id, unnest(kept) k from folded) group by query_id, frame_id)
    join joined using (query_id, frame_id) where media_type = 'video'""",
)
def w7_spread(spark, d):
    facts = V.media(spark, d).select("video_id", F.col("duration_seconds").alias("duration"))
    moments = _moments(spark, d).join(facts, "video_id").filter(F.col("media_type") == "video")
    signs = V.sign_hashes(spark, d).select(F.col("frame_id").cast("string").alias("frame_id"), "phash")
    frames = V.vectors(spark, d).select("frame_id", "video_id", "timestamp").join(signs, "frame_id")
    out = context.with_context(moments, frames, near_bits=8)
    ids = F.transform("context_frames", lambda f: f["frame_id"])
    return out.select("query_id", "frame_id", F.size(ids).cast("long").alias("n_frames"), F.array_join(ids, ",").alias("frame_list"))


@query("o3_final_results", f"{FAST} select query_id, frame_id, rank::bigint as rank from top")
def o3(spark, d):
    out = ranking.order_results(_moments(spark, d).withColumn("final_score", F.col("score")), final_results=5)
    return longs(out.select("query_id", "frame_id", "rank"), "rank")


@query(
    "a1_response_counts",
    f"""{HITS}, {S.events()} select query_id, count(*) total_candidates, count(distinct video_id || '/' || event_index) grouped_events
    from events group by query_id""",
)
def a1(spark, d):
    hits = stage(_hits(spark, d), "hits")
    return search.response_counts(hits, temporal.group_events(hits, P.group_window_s))


@query(
    "a12_evaluation",
    f"""with {S.FRAMES}, {S.PROTOTYPES}, {S.hits('proto', 50)}, golden as (
      select video_id, max(ts) / 4 lo, max(ts) * 3 / 4 hi from frames where media_type = 'video' group by video_id),
    judged as (select h.*, g.video_id = h.video_id right_video, g.video_id = h.video_id and h.ts between g.lo - 5 and g.hi + 5 hit
      from hits h join golden g on g.video_id = h.query_id),
    per as (select query_id, min(case when hit then rank end) hr, min(case when right_video then rank end) vr,
      min_by(hit, rank) filter (where right_video) top_right from judged group by query_id)
    select count(*) queries, round(avg(coalesce(hr <= 1, false)::int), 6) recall_at_1, round(avg(coalesce(hr <= 5, false)::int), 6) recall_at_5,
      round(avg(coalesce(hr <= 10, false)::int), 6) recall_at_10, round(avg(coalesce(1.0 / hr, 0)), 6) mrr,
      round(avg(coalesce(vr <= 10, false)::int), 6) video_recall, round(coalesce(avg(top_right::int), 0), 6) temporal_accuracy
    from golden g left join per p on p.query_id = g.video_id""",
)
def a12(spark, d):
    vectors = V.vectors(spark, d)
    last = F.max("timestamp")
    golden = vectors.filter(F.col("media_type") == "video").groupBy("video_id").agg(
        (last / 4).alias("expected_start"), (last * 3 / 4).alias("expected_end")
    ).select(F.col("video_id").alias("query_id"), F.col("video_id").alias("expected_video_id"), "expected_start", "expected_end")
    out = evaluate.evaluate(retrieval.top_k(vectors, _prototypes(spark, d), 50), golden, tolerance_s=5.0)
    return rounded(out, *[c for c in out.columns if c != "queries"])


@query(
    "u1_u2_union_media",
    f"""with {S.FRAMES} select frame_id, video_id, media_type, round(ts, 6) "timestamp", case media_type when 'image' then 'png' else 'h264' end codec from frames""",
)
def u12(spark, d):
    e = table(spark, d, "embeddings")
    images = e.filter("label = 9").select(
        F.col("vec_id").cast("string").alias("frame_id"),
        F.concat(F.lit("img_"), F.col("vec_id").cast("string")).alias("video_id"),
        F.lit("image").alias("media_type"), F.lit(0.0).alias("timestamp"), F.lit("png").alias("codec"),
    )
    videos = V.vectors(spark, d).filter(F.col("media_type") == "video").drop("embedding")
    return rounded(videos.unionByName(images, allowMissingColumns=True).fillna("h264", ["codec"]), "timestamp")


# --- exports of search results --------------------------------------------------------

JS_NUMBERS = {c: S.number(f"round({c}, 6)") for c in ("ts", "cs", "ce", "sim")}
CONTEXT_SQL = f"""'{X.RULE}' || e'\\nRETRIEVED EVIDENCE\\n\\nMedia: ' || filename || e'\\n\\nQuery: "' || query || e'"\\nMatch: ' || {S.hms('ts')}
  || coalesce(e'\\nSegment: ' || case when cs is not null then {S.hms('cs')} || ' - ' || {S.hms('ce')} end, '')
  || e'\\nRelevance: ' || {S.fixed('round(sim, 6)', 2)} || e'\\nRepresentative frames:\\n' || shown_lines
  || e'\\nReason: ' || reason || e'\\nSource: ' || filename || e'\\n{X.RULE}'"""


def _export_rows(spark, d):
    results = _results(spark, d, "accurate")
    for c in ("timestamp", "context_start", "context_end", "similarity"):
        results = results.withColumn(c, F.round(c, 6))
    return results.withColumn("context_text", F.lit(None).cast("string"))


from kairoscope.sources import sinks  # noqa: E402


@query("s7_export_txt", f"{SHAPED} select query_id, frame_id, {CONTEXT_SQL} line from shaped")
def s7(spark, d):
    return sinks.export_lines(_export_rows(spark, d), "txt").select("query_id", "frame_id", "line")


@query(
    "s6_export_csv",
    f"""{SHAPED} select query_id, frame_id, concat_ws(',', {S.csv('query')}, {S.csv('filename')}, media_type, {JS_NUMBERS['ts']},
      coalesce({JS_NUMBERS['cs']}, ''), coalesce({JS_NUMBERS['ce']}, ''), {JS_NUMBERS['sim']}, {S.csv('reason')}) line from shaped""",
)
def s6(spark, d):
    return sinks.export_lines(_export_rows(spark, d), "csv").select("query_id", "frame_id", "line")


JSON_FRAMES = f"""framed as (
      select query_id, frame_id, '[' || string_agg('{{"frame_id":' || to_json(nf) || ',"timestamp":' || {S.number('nt')} || ',"timestamp_hms":'
        || to_json({S.hms('nt')}) || ',"frame_url":' || to_json('frames/' || video_id || '/' || nf || '.jpg') || '}}', ',' order by nt, nf) || ']' frames_json
      from ctx_frames join (select query_id, frame_id, video_id from joined) using (query_id, frame_id) group by query_id, frame_id)"""


def _json_line(stage):
    return f"""'{{"query":' || to_json(query) || ',"media":' || to_json(filename) || ',"media_type":' || to_json(media_type)
      || ',"timestamp":' || {JS_NUMBERS['ts']} || ',"start":' || coalesce({JS_NUMBERS['cs']}, 'null') || ',"end":' || coalesce({JS_NUMBERS['ce']}, 'null')
      || ',"score":' || {JS_NUMBERS['sim']} || ',"frame_id":' || to_json(frame_id) || ',"retrieval_stage":"{stage}","context_frames":' || frames_json
      || ',"reason":' || to_json(reason) || ',"context":' || to_json({CONTEXT_SQL}) || '}}'"""


@query(
    "s5_export_json",
    f"""{SHAPED}, {JSON_FRAMES}
    select query_id, frame_id, {_json_line('coarse')} line
    from shaped join framed using (query_id, frame_id)""",
)
def s5(spark, d):
    return sinks.export_lines(_export_rows(spark, d), "json").select("query_id", "frame_id", "line")


@query(
    "f11_result_plain_text",
    f"""{SHAPED} select query_id, frame_id, 'Query: ' || query || e'\\nMedia: ' || filename || e'\\nType: ' || media_type || e'\\nTimestamp: ' || {S.hms('ts')}
      || coalesce(e'\\nSegment: ' || case when cs is not null then {S.hms('cs')} || ' - ' || {S.hms('ce')} end, '')
      || e'\\nRelevance: ' || {S.fixed('round(sim, 6)', 2)} || e'\\nRetrieval Stage: coarse\\nReason: ' || reason
      || e'\\nRepresentative frames: ' || shown || e'\\n\\nContext:\\n' || {CONTEXT_SQL} line from shaped""",
)
def f11(spark, d):
    return sinks.export_lines(_export_rows(spark, d), "plain").select("query_id", "frame_id", "line")


@query(
    "f11_copy_all",
    f"""{SHAPED} select query_id, string_agg('# Result ' || rank || e'\\n' || {CONTEXT_SQL}, e'\\n\\n' order by rank) copied_text
    from shaped group by query_id""",
)
def f11b(spark, d):
    return sinks.copy_all(_export_rows(spark, d))


SAVED_SQL = f"""'{X.RULE}' || e'\\nMedia: ' || filename || e'\\nQuery: "' || query || e'"\\nMatch: ' || {S.hms('ts')}
  || coalesce(e'\\nSegment: ' || {S.fixed('round(cs, 6)', 2)} || ' - ' || {S.fixed('round(ce, 6)', 2)}, '') || e'\\nRelevance: ' || {S.fixed('round(sim, 6)', 2)} || e'\\n{X.RULE}'"""


@query("s9_saved_contexts", f"{SHAPED} select query, frame_id, {SAVED_SQL} saved_text from shaped")
def s9(spark, d):
    from kairoscope.staging import new_path

    path = new_path(spark, "saved-contexts")
    rows = sinks.saved_context_rows(_export_rows(spark, d))
    sinks.append(rows, path)
    saved = spark.read.schema(rows.schema).parquet(path)
    return saved.select("query", "frame_id", X.saved_context_text().alias("saved_text"))


@query(
    "s8_export_all",
    f"""{SHAPED}, {JSON_FRAMES} select 'csv' format, frame_id, concat_ws(',', {S.csv('query')}, {S.csv('filename')}, media_type, {JS_NUMBERS['ts']},
      coalesce({JS_NUMBERS['cs']}, ''), coalesce({JS_NUMBERS['ce']}, ''), {JS_NUMBERS['sim']}, {S.csv('reason')}) line from shaped
    union all select 'txt', frame_id, {CONTEXT_SQL} from shaped
    union all select 'json', frame_id, {_json_line('saved')} from shaped join framed using (query_id, frame_id)""",
)
def s8(spark, d):
    saved = sinks.saved_as_results(stage(sinks.saved_context_rows(_export_rows(spark, d)), "saved"))
    parts = [sinks.export_lines(saved, f).select(F.lit(f).alias("format"), "frame_id", "line") for f in ("csv", "txt", "json")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("f13_reason", f"{SHAPED} select query_id, frame_id, reason from shaped")
def f13(spark, d):
    return _results(spark, d, "accurate").select("query_id", "frame_id", F.col("context_reason").alias("reason"))


@query(
    "f14_summary_slot",
    f"""{SHAPED} select query_id, frame_id, case when media_type = 'image' then {CONTEXT_SQL} || e'\\n\\n{X.RULE}\\nAI SUMMARY\\n\\nA still image.\\n{X.RULE}' else {CONTEXT_SQL} end line
    from shaped""",
)
def f14(spark, d):
    rows = _export_rows(spark, d).withColumn("context_summary", F.when(F.col("media_type") == "image", "A still image."))
    return sinks.export_lines(rows, "txt").select("query_id", "frame_id", "line")
