"""SQL fragments shared by the reference queries."""

from __future__ import annotations

FRAMES = """frames as (
  select cast(vec_id as varchar) frame_id,
         case when label = 9 then 'img_' || vec_id else 'clip_' || label end video_id,
         case when label = 9 then 'image' else 'video' end media_type,
         case when label = 9 then 0.0::double else vec_id::double / 5 end ts,
         embedding::double[] embedding
  from embeddings)"""

MEDIA = FRAMES + """, media as (
  select video_id, video_id || case media_type when 'video' then '.mp4' else '.png' end filename,
         media_type, count(*) frame_count,
         case media_type when 'video' then max(ts) end duration,
         make_timestamp((1704067200 + (min(frame_id::bigint) % 30) * 86400) * 1000000) uploaded_at
  from frames group by video_id, media_type)"""

# A 24-bit hash of a frame: the signs of the first values of its embedding.
SIGNS = """s as (
  select vec_id frame_id, list_sum(list_transform(range(24), lambda i: case when embedding[i + 1] > 0 then 1::bigint << i else 0 end))::bigint phash
  from embeddings)"""

QUERIES = """queries as (
  select cast(item_id as varchar) query_id, trim(text, e' \\t\\r\\n\\f\\v') query
  from benchmark where trim(text, e' \\t\\r\\n\\f\\v') <> '')"""

SPLIT = r"(?i)[ \t\r\n]+(?:next to|in front of|near|with|and|beside|behind|under)[ \t\r\n]+"

COMPONENTS = QUERIES + f""", parts as (
  select query_id, query, list_filter(list_transform(regexp_split_to_array(query, '{SPLIT}'), lambda x: trim(x)), lambda x: x <> '') p
  from queries), components as (
  select query_id, query, unnest(range(len(l))) component, unnest(l) component_text
  from (select *, case when len(p) > 1 then list_concat([query], p) else [query] end l from parts))"""


def embedded(source: str, keys: str, text: str, out: str, dim: int = 64) -> str:
    """CTEs that hash-embed ``text`` of ``source`` into ``out`` (not normalised)."""
    return f"""{out}_w as (
  select {keys}, md5(unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+'))) h from {source}), {out}_b as (
  select {keys}, ('0x' || substr(h, 1, 8))::bigint % {dim} i,
         sum(case when ('0x' || substr(h, 9, 1))::bigint % 2 = 0 then 1 else -1 end)::double v
  from {out}_w group by all), {out} as (
  select {keys}, list(coalesce(v, 0.0) order by i) embedding
  from (select {keys}, unnest(range({dim})) i from {source}) left join {out}_b using ({keys}, i)
  group by {keys})"""


QVEC = QUERIES + ", " + embedded("queries", "query_id", "query", "qvec")
CVEC = COMPONENTS + ", " + embedded("components", "query_id, component", "component_text", "cvec")

PROTOTYPES = """proto as (
  select video_id query_id, list(m order by i) embedding from (
    select video_id, i, avg(x) m from (
      select video_id, unnest(range(len(embedding))) i, unnest(embedding) x from frames where media_type = 'video')
    group by video_id, i) group by video_id)"""


def cos(a: str, b: str) -> str:
    """Cosine with 0 for a vector without length."""
    return f"coalesce(nullif(list_cosine_similarity({a}, {b}), 'nan'::double), 0)"


def hits(queries: str, k: int = 50, where: str = "true", out: str = "hits", frames: str = "frames") -> str:
    return f"""{out} as (
  select *, row_number() over (partition by query_id order by score desc, frame_id) as rank from (
    select *, round((1 + raw) / 2, 12) score from (
      select query_id, frame_id, video_id, media_type, ts, {cos('f.embedding', 'q.embedding')} raw
      from {frames} f cross join {queries} q)) where {where}
  qualify rank <= {k})"""


def fused(method: str, boost: float = 1.2, k: int = 50, frames: str = "frames") -> str:
    combine = "max" if method == "max" else "sum"
    return f"""weighted as (
  select s.*, round((1 + raw) / 2 * case when n > 1 and component = 0 then {boost} else 1 end, 12) w from (
    select c.query_id, c.component, f.frame_id, f.video_id, f.media_type, f.ts,
           {cos('f.embedding', 'c.embedding')} raw
    from {frames} f cross join cvec c) s join (select query_id, count(*) n from cvec group by 1) using (query_id)),
picked as (
  select *, {'w' if method == 'max' else 'total'} score from (
    select *, round(sum(w) over (partition by query_id, frame_id), 12) total,
           row_number() over (partition by query_id, frame_id order by w desc, component) r
    from weighted) where r = 1),
hits as (
  select *, row_number() over (partition by query_id order by score desc, frame_id) as rank
  from picked qualify rank <= {k})"""


def events(source: str = "hits", window: float = 10.0, out: str = "events") -> str:
    return f"""{out} as (
  select *, sum(s) over (partition by query_id, video_id order by ts, frame_id rows unbounded preceding)::bigint event_index
  from (select *, case when ts - lag(ts) over (partition by query_id, video_id order by ts, frame_id) > {window} then 1 else 0 end s
        from {source}))"""


def reps(source: str = "events", n: int = 1, out: str = "reps") -> str:
    return f"""{out} as (
  select *, row_number() over (partition by query_id, video_id, event_index order by score desc, ts, frame_id) row_in_event,
         min(ts) over (partition by query_id, video_id, event_index) event_start,
         max(ts) over (partition by query_id, video_id, event_index) event_end,
         count(*) over (partition by query_id, video_id, event_index) event_hits
  from {source} qualify row_in_event <= {n})"""


def reranked(source: str = "reps", out: str = "ranked", neighbour: float = 0.0, duplicate: float = 0.0) -> str:
    return f"""{out}_f as (
  select *, (1 + raw) / 2 similarity,
    row_number() over (partition by query_id, video_id order by (1 + raw) / 2 desc, ts, frame_id) row_in_video,
    count(*) over (partition by query_id, video_id order by round(ts * 1000000)::bigint range between 10000000 preceding and 10000000 following) - 1 neighbours,
    max((1 + raw) / 2) over (partition by query_id, video_id order by round(ts * 1000000)::bigint range between 1000000 preceding and 1000000 following) best_nearby
  from {source}), {out} as (
  select * exclude (rank), row_number() over (partition by query_id order by final_score desc, frame_id) as rank from (
    select *, round(similarity + 0.05 * (component = 0)::int + {neighbour} * (neighbours / (neighbours + 1.0)) + 0.05 / row_in_video
      - {duplicate} * (best_nearby > similarity)::int, 12) final_score from {out}_f))"""


def fixed(x: str, n: int) -> str:
    scaled = f"floor(abs({x}) * {10**n}::double + 0.5)::bigint"
    return (
        f"(case when {x} < 0 then '-' else '' end || ({scaled} // {10**n})::varchar || '.' "
        f"|| lpad(({scaled} % {10**n})::varchar, {n}, '0'))"
    )


def bytes_text(x: str) -> str:
    return (
        f"(case when {x} is null or isnan({x}) or isinf({x}) or {x} <= 0 then '0 B' "
        f"when {x} < 1024 then floor({x} + 0.5)::bigint || ' B' "
        f"when {x} < 1048576.0 then {fixed(f'({x} / 1024.0::double)', 2)} || ' KB' "
        f"when {x} < 1073741824.0 then {fixed(f'({x} / 1048576.0::double)', 2)} || ' MB' "
        f"when {x} < 1099511627776.0 then {fixed(f'({x} / 1073741824.0::double)', 2)} || ' GB' "
        f"else {fixed(f'({x} / 1099511627776.0::double)', 2)} || ' TB' end)"
    )


def _two(n: str) -> str:
    return f"(case when {n} < 10 then '0' else '' end || ({n})::varchar)"


def hms(x: str) -> str:
    total = f"greatest(0, floor({x} + 0.5)::bigint)"
    h, m, s = f"({total} // 3600)", f"({total} % 3600 // 60)", f"({total} % 60)"
    return (
        f"(case when {x} is null or isnan({x}) or isinf({x}) then '—' when {h} > 0 "
        f"then {_two(h)} || ':' || {_two(m)} || ':' || {_two(s)} else {_two(m)} || ':' || {_two(s)} end)"
    )


def eta(x: str) -> str:
    m = f"floor({x} / 60)::bigint"
    return (
        f"(case when {x} is null or isnan({x}) or isinf({x}) or {x} < 0 then '—' when {x} < 60 then ceil({x})::bigint || ' sec' "
        f"when {m} < 60 then {m} || 'm ' || ceil({x} - 60.0 * {m})::bigint || 's' "
        f"else ({m} // 60) || 'h ' || ({m} % 60) || 'm' end)"
    )


def number(x: str) -> str:
    return f"regexp_replace(({x})::varchar, '\\.0$', '')"


def csv(x: str) -> str:
    return (
        f"(case when regexp_matches(coalesce({x}, ''), '[\",\\n]') "
        f"then '\"' || replace({x}, '\"', '\"\"') || '\"' else coalesce({x}, '') end)"
    )


# Evidence frames of ranked moments: ``source`` has query_id, frame_id, video_id, ts, duration.
def context(source: str, window: float = 8.0, bins: int = 5) -> str:
    return f"""ctx_w as (
  select *, greatest(0.0::double, ts - {window}) low, least(coalesce(duration, ts + {window}), ts + {window}) high from {source}),
ctx_near as (
  select w.query_id, w.frame_id, w.low, w.high, f.frame_id nf, f.ts nt,
         case when w.high > w.low then least({bins - 1}, floor((f.ts - w.low) / ((w.high - w.low) / {bins}))::int) else 0 end bin
  from ctx_w w join frames f on f.video_id = w.video_id and f.ts between w.low and w.high
       and f.ts between w.ts - {window} and w.ts + {window}),
ctx_best as (
  select *, row_number() over (partition by query_id, frame_id, bin
    order by round(abs(nt - (low + (bin + 0.5::double) * ((high - low) / {bins}))), 9), nt, nf) r from ctx_near),
ctx_frames as (
  select distinct query_id, frame_id, nf, nt from (
    select query_id, frame_id, nf, nt from ctx_best where r = 1
    union all select query_id, frame_id, frame_id, ts from {source})),
ctx as (
  select query_id, frame_id, count(*) n_frames, min(nt) context_start, max(nt) context_end,
         string_agg(nf, ',' order by nt, nf) frame_list,
         string_agg({hms('nt')}, ', ' order by nt, nf) shown,
         string_agg('  ' || {hms('nt')}, e'\\n' order by nt, nf) shown_lines
  from ctx_frames group by query_id, frame_id)"""
