"""The core queries in DuckDB's SQL, each written from the definition of its result."""

from __future__ import annotations

QUERY_TEXT = "Compute shader and the vector search of every planet"

# Classes of punctuation and white space, and the pattern of a word or mark.
_P = r"\p{P}!-/:-@\[-`{-~"
_S = r"\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
_PAT = "[" + _P + "]|[^" + _P + _S + "]+"
_SPECIAL = "('[PAD]', '[UNK]', '[CLS]', '[SEP]')"


def _cos(a: str, b: str) -> str:
    scale = f"(sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"
    return f"case when {scale} > 1e-12 then round(list_dot_product({a}, {b}) / {scale}, 12) else 0 end"


_EMB = "emb as (select vec_id, embedding::double[] as vec from embeddings)"
_STORED = "stored as (select distinct chunk_ord, vec from chunk_emb where len(vec) = 64 and len(list_filter(vec, lambda x: x is null or isnan(x))) = 0)"
_CHUNK = "chunk as (select distinct chunk_ord, token_ids from chunks)"
_DOC = "doc as (select distinct doc_id, text, doc_name from documents)"
_ITEM = "item as (select distinct on (item_id) item_id, doc_name, text, token_ids, tok_start, tok_end from intake)"
_WEIGHT = f"""weight as (select token_id, case when token is null or token in {_SPECIAL} then 0.0 else 0.001 / (0.001 + case when freq > 0 then freq else 1e-9 end) end as sif, token from vocab)"""
_TOKENS = f"""{_EMB}, {_WEIGHT},
     tok as (select w.token_id, w.sif, e.vec from weight w join emb e on e.vec_id = w.token_id % (select count(*) from emb) where w.sif > 0)"""
_POOLED = f"""{_TOKENS}, {_CHUNK},
     used as (select chunk_ord, unnest(token_ids) as token_id from chunk),
     parts as (select chunk_ord, unnest(range(1, 65)) as i, sif, unnest(vec) as x from used join tok using (token_id)),
     sums as (select chunk_ord, i, sum(sif * x) / sum(sif) as x from parts group by all),
     pooled as materialized (select c.chunk_ord, coalesce(v.vec, [0.0::double for i in range(64)]) as vec
                from chunk c left join (select chunk_ord, list(x order by i) as vec from sums group by 1) v using (chunk_ord))"""


def _gram(source: str) -> str:
    """Sums of products of the centered coordinates, as one list of rows."""
    return f"""coord as (select id, unnest(range(1, 65)) as i, unnest(vec) as x from {source}),
     mean as (select i, avg(x) as m from coord group by 1),
     centered as (select id, i, x - m as x from coord join mean using (i)),
     flat as (select a.i as a, b.i as b, sum(a.x * b.x) as g from centered a join centered b using (id) group by 1, 2),
     gram as materialized (select list(r order by a) as g from (select a, list(g order by b) as r from flat group by a))"""


def _power(name: str, steps: int, against: str | None, start: str) -> str:
    take = f", (select v from {against}) as o" if against else ""
    less = "list_transform(list_zip(w, o), lambda p: p[1] - list_dot_product(w, o) * p[2])" if against else "w"
    return f"""{name}_walk as (
        select 0 as step, {start} as v
        union all
        select step + 1, list_transform(u, lambda x: x / sqrt(list_dot_product(u, u)))
        from (select step, {less} as u from (select step, list_transform(g, lambda r: list_dot_product(r, v)) as w{take} from {name}_walk, gram where step < {steps}))),
     {name} as (select v from {name}_walk where step = {steps})"""


_START = "(select list_transform(s, lambda x: x / sqrt(list_dot_product(s, s))) from (select [sin(i * 12.9898 + 1) * 0.5 + 0.5001 for i in range(64)] as s))"


def _kmeans(rounds: int = 15, k: int = 7, dim: int = 64, source: str = _EMB) -> str:
    """Rounds of Lloyd's method as a chain of materialized steps."""
    parts = [
        source,
        "ordered as (select vec_id, vec, row_number() over (order by vec_id) - 1 as o, count(*) over () as n from emb)",
        f"seed as (select c, vec as m from (select unnest(range({k})) as c), ordered where o = least(c * (n // {k}), n - 1))",
        "a0 as materialized (select vec_id, vec, arg_min(c, (list_distance(vec, m), c)) as cluster from emb, seed group by all)",
    ]
    prior = "seed"
    for r in range(1, rounds):
        parts.append(f"""m{r} as materialized (select s.c, coalesce(t.m, s.m) as m from {prior} s left join
             (select cluster as c, list(x order by i) as m from (select cluster, i, avg(x) as x from (select cluster, unnest(range({dim})) as i, unnest(vec) as x from a{r - 1}) group by all) group by 1) t using (c))""")
        parts.append(f"a{r} as materialized (select vec_id, vec, arg_min(c, (list_distance(vec, m), c)) as cluster from emb, m{r} group by all)")
        prior = f"m{r}"
    return ", ".join(parts)


def _topk(queries: str, rows: str, key: str) -> str:
    return f"""select q.id as query_id, r.id as {key}, {_cos('q.vec', 'r.vec')} as score,
       row_number() over (partition by q.id order by {_cos('q.vec', 'r.vec')} desc, r.id) as rank from {queries} q, {rows} r qualify rank <= 8"""


_QUANT = f"""{_EMB}, top as (select vec_id, vec, list_max([abs(x) for x in vec]) as m from emb),
     step as (select vec_id, vec, case when m > 1e-8 then m / 127 else 0 end as scale from top),
     coded as (select vec_id, vec, scale, [greatest(-127, least(127, round(case when scale > 0 then x * (1.0 / scale) else 0 end)))::int for x in vec] as codes from step)"""

_ESCAPE = """replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')"""
_TERMS = "|".join(t.lower() for t in QUERY_TEXT.split() if len(t) > 1)
_DRAWN = """drawn as (select chunk_ord, x, y, coalesce(cluster_no, -1) as cluster_no from map_points where x is not null and y is not null
     qualify row_number() over (partition by chunk_ord order by drawn_at desc, x, y, coalesce(cluster_no, -1)) = 1),
     box as (select (min(x) + max(x)) / 2 as cx, (min(y) + max(y)) / 2 as cy, greatest(max(x) - min(x), max(y) - min(y), 1e-6) as span from drawn),
     placed as (select chunk_ord, (x - cx) / span * 1.7 as x, (y - cy) / span * 1.7 as y, cluster_no from drawn, box)"""
# the query's tokens: greedy pieces of its words, as often as each word occurs
_ASKED = f"""asked as (select word, count(*) as times from (select unnest(regexp_extract_all(lower('{QUERY_TEXT}'), '{_PAT}')) as word) group by 1),
     cand as (select word, s, l, case when s > 0 then '##' else '' end || substring(word, s + 1, l) as piece
              from (select word, s, unnest(range(1, least(16, length(word) - s) + 1)) as l from (select word, unnest(range(0, length(word))) as s from asked))),
     best as (select word, s, arg_max(token_id, l) as id, max(l) as l from cand join vocab on token = piece group by 1, 2),
     walk as (select word, 0::bigint as pos, []::int[] as ids from asked union all
              select walk.word, pos + best.l, list_append(ids, best.id) from walk join best on best.word = walk.word and best.s = walk.pos),
     split as (select a.word, times, coalesce(ids, [1]) as ids from asked a left join (select * from walk where pos = length(word)) using (word)),
     piece as (select times, unnest(ids) as token_id from split),
     qsum as (select i, sum(times * sif * x) / sum(times * sif) as x from (select times, sif, unnest(range(1, 65)) as i, unnest(vec) as x from piece join tok using (token_id)) group by 1),
     qvec as (select list(x order by i) as v from qsum)"""
# the common component: leading eigenvector of the sums of products, by repeated products
_AXIS = f"""pcoord as (select chunk_ord as id, unnest(range(1, 65)) as i, unnest(vec) as x from pooled),
     gram as materialized (select list(r order by a) as g from (select a, list(g order by b) as r from (select a.i as a, b.i as b, sum(a.x * b.x) as g from pcoord a join pcoord b using (id) group by 1, 2) group by a)),
     {_power('axis', 200, None, _START)},
     bare as (select chunk_ord, list_transform(list_zip(vec, v), lambda q: q[1] - list_dot_product(vec, v) * q[2]) as vec from pooled, axis)"""
_WORDS = f"word as (select unnest(regexp_extract_all(lower(text), '{_PAT}')) as word from doc)"
# greedy pieces of every distinct word
_PIECES = """w as (select distinct word from word),
     cand as (select word, s, l, case when s > 0 then '##' else '' end || substring(word, s + 1, l) as piece
              from (select word, s, unnest(range(1, least(16, length(word) - s) + 1)) as l from (select word, unnest(range(0, length(word))) as s from w where length(word) <= 100))),
     best as (select word, s, arg_max(token_id, l) as id, max(l) as l from cand join vocab on token = piece group by 1, 2),
     walk as (select word, 0::bigint as pos, []::int[] as ids from w union all
              select walk.word, pos + best.l, list_append(ids, best.id) from walk join best on best.word = walk.word and best.s = walk.pos)"""
# the same chunks pooled from the codes of the tokens
_CODED = """qtok as (select token_id, sif, case when m > 1e-8 then [greatest(-127, least(127, round(x * (1.0 / (m / 127))))) * (m / 127) for x in vec] else [0.0 for x in vec] end as vec
              from (select *, list_max([abs(x) for x in vec]) as m from tok)),
     qparts as (select chunk_ord, unnest(range(1, 65)) as i, sif, unnest(vec) as x from used join qtok using (token_id)),
     qsums as (select chunk_ord, i, sum(sif * x) / sum(sif) as x from qparts group by all),
     qpooled as (select c.chunk_ord, coalesce(v.vec, [0.0::double for i in range(64)]) as vec from chunk c left join (select chunk_ord, list(x order by i) as vec from qsums group by 1) v using (chunk_ord)),
     qbare as (select chunk_ord, list_transform(list_zip(vec, v), lambda q: q[1] - list_dot_product(vec, v) * q[2]) as vec from qpooled, axis)"""
_FILES = "files as (select doc_hash, count(distinct chunk_ord) as chunks from chunks where doc_hash is not null group by 1)"

ORACLE_SQL = {
    "cosine_topk": f"with {_EMB} select e.vec_id, round({_cos('q.vec', 'e.vec')}, 6) as score from emb e, emb q where q.vec_id = 0 order by {_cos('q.vec', 'e.vec')} desc, e.vec_id limit 8",
    "cosine_topk_batch": f"with {_EMB}, r as (select vec_id as id, vec from emb), q as (select * from r where id % 50 = 0), hit as ({_topk('q', 'r', 'vec_id')}) select query_id, rank, vec_id, round(score, 6) as score from hit",
    "chunk_search": f"""with {_STORED}, r as (select chunk_ord as id, vec from stored), q as (select * from r where id % 50 = 0), hit as ({_topk('q', 'r', 'chunk_ord')}),
        texts as (select distinct chunk_ord, text from chunks)
        select query_id, rank, chunk_ord, round(score, 6) as score, case when length(text) > 60 then text[1:60] || '…' else text end as preview from hit join texts using (chunk_ord)""",
    "dot_norm": f"with {_EMB} select e.vec_id, round(sqrt(list_dot_product(e.vec, e.vec)), 6) as norm, round(list_dot_product(e.vec, q.vec), 6) as dot0 from emb e, emb q where q.vec_id = 0",
    "similarity_to_mean": f"""with {_EMB}, coord as (select unnest(range(64)) as i, unnest(vec) as x from emb), mean as (select list(m order by i) as m from (select i, avg(x) as m from coord group by 1)),
        j as (select vec_id, vec, m, list_dot_product(vec, m) as p from emb, mean)
        select vec_id, round({_cos('vec', 'm')}, 6) as cos_mean, round(sqrt(list_sum([(q[1] - p * q[2]) ** 2 for q in list_zip(vec, m)])), 6) as rest_norm from j""",
    "topk_overlap": f"""with {_QUANT}, r as (select vec_id as id, vec from emb), back as (select vec_id as id, [c * scale for c in codes] as vec from coded), q as (select * from r where id % 50 = 0),
        a as ({_topk('q', 'r', 'vec_id')}), b as ({_topk('q', 'back', 'vec_id')})
        select a.query_id, round(count(b.score) / count(*), 6) as overlap, round(coalesce(max(abs(a.score - b.score)), 0), 5) as max_delta from a left join b using (query_id, vec_id) group by 1""",
    "quantize_rows": f"with {_QUANT} select vec_id, round(scale, 9) as scale, codes from coded",
    "quantize_error": f"""with {_QUANT}, back as (select vec_id, vec, [c * scale for c in codes] as b from coded)
        select vec_id, round(list_max([abs(p[1] - p[2]) for p in list_zip(vec, b)]), 8) as max_error, round({_cos('vec', 'b')}, 8) as cosine from back""",
    "quantize_report": f"""with {_STORED}, {_QUANT.replace(_EMB + ', ', '').replace('vec_id', 'chunk_ord').replace('from emb', 'from stored')},
        back as (select vec, [c * scale for c in codes] as b from coded), each as (select list_max([abs(p[1] - p[2]) for p in list_zip(vec, b)]) as e, {_cos('vec', 'b')} as c from back)
        select count(*) as rows, round(min(c), 8) as min_cosine, round(avg(c), 8) as mean_cosine, round(max(c), 8) as max_cosine, round(max(e), 8) as max_error from each""",
    "compression_ratio": f"with {_STORED} select (count(*) * 64 * 4)::bigint as fp32_bytes, (count(*) * 68)::bigint as int8_bytes, round(count(*) * 256 / (count(*) * 68), 6) as ratio from stored",
    "sif_weights": f"with {_WEIGHT} select token_id, token, round(sif, 6) as sif from weight",
    "vocab_build": f"""with {_DOC}, {_WORDS},
        chars as (select chr(i::int) as c, row_number() over (order by case when i > 90 then 0 else 1 end, i) as r from (select unnest(list_concat(range(97, 123), range(48, 58))) as i)),
        head as (select unnest([0, 1, 2, 3]) as token_id, unnest(['[PAD]', '[UNK]', '[CLS]', '[SEP]']) as token union all select 3 + r, c from chars union all select 39 + r, '##' || c from chars),
        counted as (select word, count(*) as n from word where word not in (select token from head) group by 1)
        select token_id::int as token_id, token from head union all
        select (row_number() over (order by n desc, word) + 75)::int, word from counted qualify row_number() over (order by n desc, word) <= 1924""",
    "vocab_offsets": "select token_id, coalesce(sum(strlen(token)) over (order by token_id rows between unbounded preceding and 1 preceding), 0)::bigint as offset, coalesce(strlen(token), 0)::int as length from vocab",
    "vocab_preview": "select token_id, token from vocab order by token_id limit 200",
    "report_lines": f"""with {_STORED}, {_QUANT.replace(_EMB + ', ', '').replace('vec_id', 'chunk_ord').replace('from emb', 'from stored')},
        back as (select chunk_ord, vec, [c * scale for c in codes] as b from coded)
        select chunk_ord, format('  {{:.5f}}  ', {_cos('vec', 'b')}) || chunk_ord as line from back""",
    "raw_roundtrip": f"with {_EMB} select vec_id, [round(x, 6) + 0.0 for x in vec] as vec from emb",
    "vocab_lookup": f"with {_CHUNK}, used as (select unnest(token_ids) as token_id from chunk), c as (select token_id, count(*) as n from used where token_id is not null group by 1) select c.token_id, coalesce(v.token, '') as token, n from c left join vocab v using (token_id)",
    "pretokenize_counts": f"with {_DOC}, w as (select doc_id, regexp_extract_all(lower(text), '{_PAT}') as w from doc where text is not null) select doc_id, len(w)::int as words, len(list_distinct(w))::int as distinct_words from w",
    "word_freq": f"with {_DOC}, {_WORDS} select word, count(*) as n from word group by 1",
    "wordpiece_pieces": f"""with recursive {_DOC}, {_WORDS}, {_PIECES},
        done as (select word, ids from walk where pos = length(word))
        select w.word, coalesce(done.ids, [1]) as pieces from w left join done using (word)""",
    "html_escaped": f"with {_DOC} select doc_id, {_ESCAPE} as html from doc",
    "highlighted": f"with {_DOC} select doc_id, regexp_replace({_ESCAPE}, '({_TERMS})', '<mark>\\1</mark>', 'gi') as html from doc",
    "preview_truncate": "select chunk_ord, case when length(text) > 220 then text[1:220] || '…' else text end as preview from (select distinct chunk_ord, text from chunks)",
    "format_bytes": f"""with {_DOC}, s as (select doc_id, strlen(text) * 97.0::double as n from doc where text is not null)
        select doc_id, case when n < 1024 then n::bigint || ' B' when n < 1048576 then format('{{:.1f}} KB', n / 1024) when n < 1073741824 then format('{{:.1f}} MB', n / 1048576) else format('{{:.1f}} GB', n / 1073741824) end as size from s""",
    "file_types": f"with {_DOC}, e as (select lower(regexp_extract(doc_name, '\\.([^.]*)$', 1)) as extension from doc where doc_name is not null) select extension, count(*) as n, extension in ('txt', 'md', 'markdown', 'pdf') as readable from e group by 1",
    "window_counts": f"with {_ITEM}, n as (select item_id, coalesce(len(token_ids), 0) as n from item) select item_id, case when n = 0 then 0 when n <= 128 then 1 else ceil((n - 128) / 96)::int + 1 end::int as windows from n",
    "token_windows": f"""with {_ITEM}, s as (select *, unnest([x for x in range(0, len(token_ids)::bigint, 96) if x = 0 or x + 32 < len(token_ids)]) as start from item),
        w as (select *, token_ids[start + 1:start + 128] as ids, tok_start[start + 1] as a, tok_end[least(start + 128, len(tok_end))] as b from s)
        select item_id, start::int as start, len(ids)::int as n_tok, ids as token_ids, a as char_start, b as char_end, substring(text, a + 1, b - a) as chunk_text, concat_ws('#', doc_name, start) as chunk_id from w""",
    "csr_offsets": f"with {_CHUNK} select chunk_ord, coalesce(sum(len(token_ids)) over (order by chunk_ord rows between unbounded preceding and 1 preceding), 0)::bigint as offset, coalesce(len(token_ids), 0)::int as n from chunk",
    "resampled": "with e as (select vec_id, label, row_number() over (order by vec_id) - 1 as o, count(*) over () as n from embeddings), s as (select unnest(range((select count(*) from embeddings) * 7 // 2)) as sample_id) select sample_id, vec_id, label from s join e on o = sample_id % n",
    "sif_pool": f"with {_POOLED} select chunk_ord, [round(x, 5) + 0.0 for x in vec] as vec from pooled",
    "pc_remove": f"with recursive {_POOLED}, {_AXIS} select chunk_ord, round(sqrt(list_dot_product(vec, vec)), 4) as norm from bare",
    "embed_search": f"""with recursive {_POOLED}, {_AXIS}, {_ASKED},
        q as (select list_transform(list_zip(qvec.v, axis.v), lambda p: p[1] - list_dot_product(qvec.v, axis.v) * p[2]) as vec from qvec, axis)
        select b.chunk_ord, round({_cos('q.vec', 'b.vec')}, 5) as score from bare b, q order by {_cos('q.vec', 'b.vec')} desc, b.chunk_ord limit 8""",
    "column_means": f"with {_STORED}, coord as (select unnest(range(64)) as i, unnest(vec) as x from stored) select i::int as i, round(avg(x), 6) as mean from coord group by 1",
    "gram_matrix": f"with {_STORED}, coord as (select chunk_ord, unnest(range(64)) as i, unnest(vec) as x from stored) select a.i::int as a, b.i::int as b, round(sum(a.x * b.x), 9) as g from coord a join coord b using (chunk_ord) group by 1, 2",
    "project2d": f"""with recursive {_STORED}, src as (select chunk_ord as id, vec from stored), {_gram('src')}, {_power('first', 60, None, _START)}, {_power('second', 60, 'first', _START)}
        select chunk_ord, round(list_dot_product(s.vec, f.v), 4) as x, round(list_dot_product(s.vec, g.v), 4) as y from stored s, first f, second g""",
    "map_normalize": f"with {_DRAWN} select chunk_ord, round(x, 6) as x, round(y, 6) as y, ((cluster_no % 8) + 8) % 8 as colour from placed",
    "nearest_pick": f"with {_DRAWN}, dist as (select chunk_ord, (x - 0.1) * (x - 0.1) + (y - 0.05) * (y - 0.05) as dist2 from placed), one as (select * from dist order by dist2, chunk_ord limit 1) select chunk_ord, round(dist2, 8) as dist2 from one where dist2 < 0.01",
    "kmeans_assign": "with " + _kmeans() + " select vec_id, cluster::int as cluster from a14",
    "kmeans_sizes": "with " + _kmeans() + " select cluster::int as cluster, count(*) as n from a14 group by 1",
    "doc_hash": f"with {_DOC} select doc_id, sha256(text) as doc_hash from doc",
    "cache_hits": f"with {_FILES} select doc_hash, chunks from files where doc_hash in (select doc_hash from cached_docs where doc_hash is not null)",
    "cache_misses": f"with {_FILES} select doc_hash, chunks from files where doc_hash not in (select doc_hash from cached_docs where doc_hash is not null)",
    "cached_counts": f"with {_FILES}, meta as (select doc_hash, max(chunk_count) as stored from cached_docs group by 1) select doc_hash, chunks, coalesce(stored, -1) as stored from files join meta using (doc_hash) where stored is null or stored <> chunks",
    "union_corpus": "select origin, coalesce(trim(text, ' ') = '', true) as blank, count(*) as n from (select 'documents' as origin, text from documents union all select 'intake', text from intake) group by 1, 2",
    "distinct_docs": "select doc_name, count(distinct doc_id) as docs, count(distinct text) as texts from documents where doc_name is not null group by 1",
    "latest_meta": "select doc_hash, meta_id, doc_name from (select distinct * from cached_docs) where doc_hash is not null qualify row_number() over (partition by doc_hash order by synced_at desc nulls last, meta_id) = 1",
    "token_search": f"""with {_POOLED}, r as (select chunk_ord as id, vec from pooled), q as (select r.* from r join chunk on id = chunk_ord where id % 50 = 0 and len(token_ids) > 0), hit as ({_topk('q', 'r', 'chunk_ord')})
        select query_id, rank, chunk_ord, round(score, 6) as score from hit""",
    "quantized_pool": f"with recursive {_POOLED}, {_AXIS}, {_CODED} select b.chunk_ord, round({_cos('b.vec', 'q.vec')}, 6) as cosine from bare b join qbare q using (chunk_ord)",
    "quantized_pool_report": f"""with recursive {_POOLED}, {_AXIS}, {_CODED},
        c as (select case when list_dot_product(b.vec, b.vec) > 0 and list_dot_product(q.vec, q.vec) > 0 then {_cos('b.vec', 'q.vec')} else 1 end as c from bare b join qbare q using (chunk_ord))
        select count(*) as rows, round(min(c), 6) as min_cosine, round(avg(c), 6) as mean_cosine, round(max(c), 6) as max_cosine from c""",
    "report_head": f"""with {_STORED}, {_QUANT.replace(_EMB + ', ', '').replace('vec_id', 'chunk_ord').replace('from emb', 'from stored')},
        back as (select vec, [c * scale for c in codes] as b from coded), cosine as (select {_cos('vec', 'b')} as c from back),
        num as (select count(*) * 256.0 / 1048576 as f, count(*) * 68.0 / 1048576 as q, min(c) as low, avg(c) as mean, max(c) as high from cosine)
        select line_no::int as line_no, line from (select unnest(range(6)) as line_no,
               unnest([format('fp32 size: {{:.4f}} MB', f), format('int8 size: {{:.4f}} MB', q), format('ratio: {{:.4f}}x', f / q), format('min cosine: {{:.6f}}', low), format('mean cosine: {{:.6f}}', mean), format('max cosine: {{:.6f}}', high)]) as line from num)""",
    "map_clusters": f"""with recursive {_STORED}, src as (select chunk_ord as id, vec from stored), {_gram('src')}, {_power('first', 60, None, _START)}, {_power('second', 60, 'first', _START)},
        {_kmeans(source='emb as (select chunk_ord as vec_id, vec from stored)')}
        select chunk_ord, round(list_dot_product(s.vec, f.v), 4) as x, round(list_dot_product(s.vec, g.v), 4) as y, a.cluster::int as cluster, (a.cluster % 8)::int as colour
        from stored s join a14 a on a.vec_id = s.chunk_ord, first f, second g""",
    "token_spans": f"""with recursive {_DOC}, {_WORDS}, {_PIECES},
        done as (select word, ids from walk where pos = length(word)),
        seg as (select doc_id, unnest(range(1, len(p) + 1)) as k, unnest(p) as s from (select doc_id, regexp_extract_all(text, '[{_S}]+|{_PAT}') as p from doc)),
        place as (select doc_id, k, s, coalesce(sum(length(s)) over (partition by doc_id order by k rows between unbounded preceding and 1 preceding), 0)::int as a from seg),
        piece as (select doc_id, k, a, (a + length(s))::int as b, unnest(range(1, len(coalesce(ids, [1])) + 1)) as j, unnest(coalesce(ids, [1])) as id
                  from place left join done on word = lower(s) where regexp_full_match(s, '{_PAT}')),
        lists as (select doc_id, list(id order by k, j) as ids, list(a order by k, j) as a, list(b order by k, j) as b from piece group by 1)
        select doc_id, coalesce(ids, []) as token_ids, coalesce(a, []) as tok_start, coalesce(b, []) as tok_end from doc left join lists using (doc_id) where text is not null""",
    "packed_sections": """with v as (select count(*) as n, coalesce(sum(strlen(token)), 0) as heap from vocab), h as (select n, 40 + 4 * (n + 1) as heap_at, 40 + 4 * (n + 1) + 4 * ((heap + 3) // 4) as codes_at from v)
        select section, starts::bigint as starts from (select unnest(['offsets', 'heap', 'codes', 'scales', 'weights', 'components', 'end']) as section,
               unnest([40, heap_at, codes_at, codes_at + 64 * n, codes_at + 68 * n, codes_at + 72 * n, codes_at + 72 * n + 256]) as starts from h)""",
    "vocab_file_roundtrip": "select token_id, coalesce(token, '') as token from vocab",
    "missing_ids": "select i::int as token_id from (select unnest(range(40000)) as i) where i not in (select token_id from vocab where token is not null)",
    "codec_roundtrip": f"""with {_WEIGHT}, {_QUANT} select w.token_id, coalesce(w.token, '') as token, c.codes, round(c.scale::float::double, 6) as scale, round(w.sif::float::double, 6) as sif
        from weight w join coded c on c.vec_id = w.token_id % (select count(*) from emb)""",
    "corpus_roundtrip": "select doc_name as name, count(*) as n, sum(coalesce(length(text), 0))::bigint as chars from documents group by 1",
    "store_roundtrip": f"select sha256(text) as doc_hash, min(doc_name) as doc_name, bool_or(len(regexp_extract_all(lower(text), '{_PAT}')) > 0) as has_windows from documents where text is not null group by text",
    "store_chunks": f"""with {_ITEM}, n as (select sha256(text) as doc_hash, len(token_ids) as n, tok_end from item where text is not null and len(token_ids) > 0)
        select doc_hash, sum(case when n <= 128 then 1 else ceil((n - 128) / 96)::bigint + 1 end)::bigint as windows, max(list_last(tok_end)) as last_char from n group by 1""",
    "store_lookup": f"""with {_ITEM}, one as (select * from item where text is not null and len(token_ids) > 0 order by item_id limit 1),
        s as (select *, unnest([x for x in range(0, len(token_ids)::bigint, 96) if x = 0 or x + 32 < len(token_ids)]) as start, (select min(doc_name) from item where item.text = one.text) as known_as from one)
        select start::int as start, tok_start[start + 1] as char_start, tok_end[least(start + 128, len(tok_end))] as char_end, len(token_ids[start + 1:start + 128])::int as n_tok, known_as from s""",
    "store_cleared": f"with {_ITEM} select 'before' as at, count(distinct text) as docs from item union all select 'after', 0",
    "stream_ingest": f"select sha256(text) as doc_hash, 0 as first_start, min(doc_name) as doc_name from documents where text is not null and len(regexp_extract_all(lower(text), '{_PAT}')) > 0 group by text",
}
