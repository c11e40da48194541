"""The registered queries in DuckDB SQL, over the same tables."""

from __future__ import annotations

from gleanery.functions.stopwords import ENGLISH

TOPIC = "rewh thatin orre ononst"
RUN_TS = "2026-01-01T00:00:00+00:00"

_SPACE = r"[\s\x1c-\x1f\x0b\x{85}\p{Z}]"
_TRIM = rf"^{_SPACE}+|{_SPACE}+$"
_NAV = r"(?i)^(home|about|contact|menu|navigation|skip to|cookie|privacy|terms|subscribe|sign up|log in|login|search|all rights reserved|copyright|[0-9]{4}[-–][0-9]{4})"
_STOP = "[" + ", ".join(f"'{w}'" for w in ENGLISH) + "]"


def _clean(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), '{_SPACE}+', ' ', 'g'))"


def _share(x: str) -> str:
    return rf"len(regexp_extract_all({x}, '[^\p{{L}}\p{{N}}\s\x1c-\x1f\x0b\x{{85}}\p{{Z}}]'))::double / greatest(length({x}), 1)"


def _paragraph(x: str) -> str:
    return f"length({x}) >= 60 and not regexp_matches({x}, '{_NAV}') and {_share(x)} <= 0.35"


def _tokens(x: str) -> str:
    return rf"list_filter(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda t: not list_contains({_STOP}, t))"


def _bigrams(x: str) -> str:
    return f"list_concat({x}, list_transform(range(1, greatest(len({x}), 1)), lambda i: {x}[i] || ' ' || {x}[i + 1]))"


def _hash(x: str) -> str:
    return rf"sha1(lower(regexp_replace({x}, '{_TRIM}', '', 'g')))"


_LINES = "select 'doc:' || doc_id as source_url, (unnest(range(1, len(ls) + 1)) - 1)::int as item_idx, unnest(ls) as text, lang from (select doc_id, lang, string_split(text, chr(10)) as ls from documents)"
_CAPTIONS = f"select source_url, item_idx, 'https://img.example.com/' || source_url || '/' || item_idx || '.png' as image_url, text as caption from ({_LINES})"
_WHOLE = "select 'doc:' || doc_id as source_url, 0 as item_idx, text, doc_id from documents"
_UNIQUE = f"select * from (select *, row_number() over (partition by {_hash('text')} order by source_url, item_idx) as r from ({_WHOLE})) where r = 1"
_RANKED = r"""select 'Page ' || page_id as title, url, ltrim(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), 'w.') as domain,
  greatest(round(1.0 - 0.02 * (row_number() over (order by page_id) - 1), 3), 0.1)::double as relevance_score, true as selected
  from pages where url like 'http%' and not contains(url, 'duckduckgo.com') and not contains(url, 'bing.com/aclick')"""


def _cosine(items: str, text: str, topic: str, cap: int, bigrams: bool, sublinear: bool) -> str:
    """CTEs up to `cos`(source_url, item_idx, cosine) for items that have been defined as a relation."""
    terms = _bigrams("tk") if bigrams else "tk"
    w = "(1 + ln(tf))" if sublinear else "tf"
    return f"""it as ({items}),
tk as materialized (select source_url, item_idx, {_tokens(text)} as tk from it union all select '', -1, {_tokens(f"'{topic}'")}),
tf as materialized (select source_url, item_idx, term, count(*)::double as tf from (select source_url, item_idx, unnest({terms}) as term from tk) group by all),
vo as materialized (select term, ln(((select count(*) from it) + 2.0) / (count(*) + 1.0)) + 1.0 as idf from tf group by term order by sum(tf) desc, term limit {cap}),
we as materialized (select source_url, item_idx, term, {w} * idf as w from tf join vo using (term)),
qw as (select term, w as wq from we where item_idx = -1),
cos as (select i.source_url, i.item_idx, coalesce(s.dot / (s.norm * (select sqrt(sum(wq * wq)) from qw)), 0.0) as cosine
  from it i left join (select source_url, item_idx, sum(w * coalesce(wq, 0)) as dot, sqrt(sum(w * w)) as norm from we left join qw using (term) where item_idx >= 0 group by all) s
  using (source_url, item_idx))"""


_CLEANED = f"select * from (select source_url, item_idx, {_clean('text')} as text from ({_LINES})) where {_paragraph('text')}"
_SCORED = f"{_cosine(_CLEANED, 'text', TOPIC, 10_000, True, True)}, sc as materialized (select source_url, item_idx, text, round(cosine, 4) as score from cos join it using (source_url, item_idx) where cosine >= 0.05)"
_KEPT = f"{_SCORED}, kept as (select * from (select *, row_number() over (partition by {_hash('text')} order by score desc, source_url, item_idx) as r from sc) where r = 1)"

_PAIRS = f"""un as materialized ({_UNIQUE}),
tf as materialized (select doc_id, term, count(*)::double as tf from (select doc_id, unnest({_tokens('text')}) as term from un) group by all),
vo as (select term, ln(((select count(*) from un) + 1.0) / (count(*) + 1.0)) + 1.0 as idf from tf group by term order by sum(tf) desc, term limit 5000),
rw as (select doc_id, term, (1 + ln(tf)) * idf as w from tf join vo using (term)),
vec as materialized (select doc_id, term, w / sqrt(sum(w * w) over (partition by doc_id)) as w from rw),
p as materialized (select a.doc_id as a, b.doc_id as b, sum(a.w * b.w) as sim from vec a join vec b on a.term = b.term and a.doc_id < b.doc_id group by all having sum(a.w * b.w) >= 0.85)"""


def _fuzzy(rounds: int = 6) -> str:
    """Greedy removal with its rounds written out; ids order as text, as source_url does."""
    first = """o as materialized (select case when 'doc:' || a < 'doc:' || b then a else b end as e, case when 'doc:' || a < 'doc:' || b then b else a end as l from p),
s0 as (select id, null::boolean as kept from (select e as id from o union select l from o))"""
    steps = []
    for k in range(rounds):
        steps.append(f"""s{k + 1} as materialized (select s.id, coalesce(s.kept, case when coalesce(n.bk, false) then false when not coalesce(n.w, false) then true end) as kept
  from s{k} s left join (select o.l as id, bool_or(coalesce(x.kept, false)) as bk, bool_or(x.kept is null) as w from o join s{k} x on x.id = o.e group by o.l) n using (id))""")
    return f"with {_PAIRS}, {first}, {', '.join(steps)} select source_url from un where doc_id not in (select id from s{rounds} where not kept)"


_STOPTAGS = "['the', 'a', 'an', 'and', 'or', 'but', 'is', 'on', 'in', 'to', 'for', 'with', 'of', 'at', 'by', 'from', 'as', 'stock', 'photo', 'image', 'picture', 'royalty-free', 'premium', 'high-res']"


def _bounded(x: str) -> str:
    """Letters and digits beyond ASCII as 0 and other characters beyond ASCII as ~: DuckDB's word boundaries know ASCII only."""
    return rf"regexp_replace(regexp_replace({x}, '[^\x00-\x7F\p{{L}}\p{{N}}\p{{M}}]', '~', 'g'), '[^\x00-\x7F]', '0', 'g')"


def _first_seen(x: str) -> str:
    """Distinct elements in order of their first occurrence."""
    return f"list_transform(list_sort(list_transform(list_distinct({x}), lambda v: {{'at': list_position({x}, v), 'v': v}})), lambda s: s.v)"


def _entities(x: str, longer: int, stop: bool) -> str:
    found = rf"regexp_extract_all({_bounded(x)}, '\b[A-Z][a-zA-Z]*(?:\s+[A-Z][a-zA-Z]*)*\b')"
    keep = f"length(e) > {longer}" + (f" and not list_contains({_STOPTAGS}, lower(e))" if stop else "")
    return f"list_filter({_first_seen(found)}, lambda e: {keep})"


def _tags(x: str) -> str:
    found = rf"list_filter(regexp_extract_all({_bounded(f'lower({x})')}, '\b[a-zA-Z_-]+\b'), lambda w: length(w) > 2 and not list_contains({_STOPTAGS}, w))"
    return f"{_first_seen(found)}[1:5]"


_CATEGORY = "case when list_has_any(tg, ['thth', 'thon', 'that']) then 'first' when list_has_any(tg, ['ering', 'anre', 'with']) then 'second' when list_has_any(tg, ['and', 'this', 'are']) then 'third' else 'general' end"
_CLEAN_CAPTIONS = rf"""select source_url, item_idx, image_url, caption from (select source_url, item_idx, image_url, {_clean(rf"regexp_replace(regexp_replace(caption, '(?i)(stock pictures, royalty-free photos & images|royalty-free images|stock photos|high-res pictures).*', ''), '{_TRIM}', '', 'g')")} as caption
  from ({_CAPTIONS}) where caption <> '' and not regexp_matches(lower(caption), 'istock|getty|shutterstock|stock images|stock pictures|royalty-free|premium high-res|download free')) where length(caption) > 3"""
_MENTIONS = f"select source_url, item_idx, unnest({_entities('text', 2, False)}) as node from ({_LINES})"
_EDGES = f"m as materialized ({_MENTIONS}), nd as materialized (select node, count(*) as weight from m group by node), ed as materialized (select a.node as src, b.node as dst, count(*) as weight from m a join m b on a.source_url = b.source_url and a.item_idx = b.item_idx and a.node < b.node group by all)"


def _ranks(rounds: int = 10) -> str:
    steps = [f"""{_EDGES}, bo as (select src, dst, weight from ed union all select dst, src, weight from ed),
dg as (select src, sum(weight) as d from bo group by src), lk as materialized (select bo.src, bo.dst, bo.weight / dg.d as share from bo join dg using (src)),
lo as (select node from nd where node not in (select src from dg)), nn as (select count(*)::double as n from nd), r0 as (select node, 1.0 / (select n from nn) as pr from nd)"""]
    for k in range(rounds):
        steps.append(f"""r{k + 1} as materialized (select nd.node, 0.85 * (coalesce(g.got, 0) + (select coalesce(sum(pr), 0) from r{k} where node in (select node from lo)) / (select n from nn)) + 0.15 / (select n from nn) as pr
  from nd left join (select lk.dst as node, sum(r.pr * lk.share) as got from lk join r{k} r on r.node = lk.src group by lk.dst) g using (node))""")
    return ", ".join(steps)


def _converged(rounds: int = 40, tol: float = 1e-6) -> str:
    """The ranks after the first round with a change below the bound, out of as many rounds as are written out."""
    change = " union all ".join(f"select {k} as k, (select sum(abs(b.pr - a.pr)) from r{k - 1} a join r{k} b using (node)) as c" for k in range(1, rounds + 1))
    every = " union all ".join(f"select {k} as k, node, pr from r{k}" for k in range(1, rounds + 1))
    return f"{_ranks(rounds)}, ch as ({change}), stop as (select min(k) as k from ch where c < (select n from nn) * {tol}) select node, round(pr * 1e6, 1) as pagerank from ({every}) join stop using (k)"


_EVENTS = f"select event_id, 'user:' || user_id as source_url, json_keys(props) as ks, props from events"
_AUDIO = "select 'conv:' || conv_id as source_url, turn::int as item_idx, 'https://a.example.com/' || conv_id || '.mp3' as audio_url, 'mp3' as ext, case when turn % 2 = 0 and coalesce(role, '') <> '' then " + rf"regexp_replace(text || ' ' || role, '{_TRIM}', '', 'g')" + " else text end as transcript from conversations"
_EXT = "case when contains(l, 'png') then 'png' when contains(l, 'webp') then 'webp' when contains(l, 'wav') then 'wav' else '{}' end"


_STORED = """select page_id // 10 as query, (row_number() over (partition by page_id // 10 order by page_id) - 1)::int as position, 'Page' || page_id as title, url,
case when page_id % 5 = 0 then url when page_id % 3 = 0 then '//duckduckgo.com/l/?uddg=' || url_encode(url) || '&rut=1' else url end as href from pages qualify page_id % 7 <> 0"""


def _recordings(name: str, end: str) -> str:
    return f"""select path, url from (select page_id, {name} || format('{{:04d}}', row_number() over (order by page_id) - 1) || '.' || {end} as path, url
from (select page_id, url || (['.mp3', '.WAV', '.ogg'])[page_id % 3 + 1] as url from pages)) where page_id % 2 = 0 or page_id % 7 <> 0"""


_DIGEST = """with c as (select user_id as job, ts, event_id as seq, event_type as message, lag(event_type) over (partition by user_id order by ts, event_id) as last from events),
k as (select *, row_number() over (partition by job order by ts desc, seq desc) as r, case when contains(lower(message), 'failed') or contains(lower(message), 'error') then 'error' when contains(lower(message), 'retry') or contains(lower(message), 'blocked') then 'warn' else 'info' end as kind from c where last is null or message <> last)
select job, seq, message, kind, count(*) filter (where kind = 'error') over (partition by job) as errors from k where r <= 30"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name; queries that read HTML have none."""
    suffixes = "(values ('text', ''), ('image_cnn', ' high resolution images gallery photos'), ('audio', ' audio clips sound wav mp3 download'), ('graph_gnn', ' categories hierarchy taxonomy relationships'), ('network', ' data statistics table csv numerical')) s(modality, suffix)"
    line = f"select source_url, item_idx, {_clean('text')} as c from ({_LINES})"
    return {
        "page_domains": r"select url, ltrim(h, 'w.') as domain_compatible, regexp_replace(h, '^www\.', '') as domain from (select url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) as h from (select distinct url from pages))",
        "rank_sources": f"select * from ({_RANKED} order by page_id limit 50)",
        "modality_query": f"select item_id, modality, text || suffix as query from benchmark, {suffixes}",
        "clean_paragraphs": f"select source_url, sha1(c) as sha, length(c) as n from (select source_url, {_clean('text')} as c from ({_WHOLE})) where {_paragraph('c')}",
        "boilerplate_flags": f"select source_url, item_idx, regexp_matches(c, '{_NAV}') as navigation, length(c) < 60 as short from ({line})",
        "special_ratio": f"select source_url, item_idx, round({_share('c')}, 6) as share from ({line})",
        "exact_dedup": f"select source_url from ({_UNIQUE})",
        "tokens": f"select source_url, item_idx, array_to_string({_tokens('text')}, ' ') as tokens from ({_LINES})",
        "bigrams": f"select term, count(*) as n from (select unnest({_bigrams('tk')}) as term from (select {_tokens('text')} as tk from ({_LINES}))) group by term having count(*) > 1",
        "tfidf_idf": f"select term, count(*) as df, sum(tf)::bigint as total, round(ln(((select count(*) from documents) + 1.0) / (count(*) + 1.0)) + 1.0, 6) as idf from (select doc_id, term, count(*) as tf from (select doc_id, unnest({_tokens('text')}) as term from documents) group by all) group by term",
        "vocab_topk": f"select term, sum(tf)::bigint as total, count(*) as df from (select doc_id, term, count(*) as tf from (select doc_id, unnest({_tokens('text')}) as term from documents) group by all) group by term order by total desc, term limit 5000",
        "score_paragraphs": f"with {_SCORED} select source_url, item_idx, score from sc",
        "score_topics": f"""with d as (select 'doc:' || doc_id as source_url, 0 as item_idx, text from documents),
tf as materialized (select source_url, item_idx, term, count(*)::double as tf from (select source_url, item_idx, unnest({_tokens('text')}) as term from d) group by all),
vo as materialized (select term, ln(((select count(*) from d) + 1.0) / (count(*) + 1.0)) + 1.0 as idf from tf group by term order by sum(tf) desc, term limit 10000),
we as materialized (select source_url, item_idx, term, (1 + ln(tf)) * idf as w from tf join vo using (term)),
nm as (select source_url, item_idx, sqrt(sum(w * w)) as n from we group by all),
qt as (select item_id as topic_id, term, count(*)::double as tf from (select item_id, unnest({_tokens('text')}) as term from benchmark) group by all),
qw as materialized (select topic_id, term, (1 + ln(tf)) * idf as wq from qt join vo using (term)),
qn as (select topic_id, sqrt(sum(wq * wq)) as qn from qw group by topic_id),
dt as (select topic_id, source_url, item_idx, sum(w * wq) as dot from we join qw using (term) group by all)
select topic_id, source_url, item_idx, round(dot / (n * qn), 4) as score from dt join nm using (source_url, item_idx) join qn using (topic_id) where dot / (n * qn) >= 0.2""",
        "similar_pairs": f"with {_PAIRS} select a, b, round(sim, 4) as sim from p",
        "fuzzy_dedup": _fuzzy(),
        "clean_captions": _CLEAN_CAPTIONS,
        "caption_entities": f"select source_url, item_idx, array_to_string({_entities('caption', 3, True)}, '|') as entities from ({_CAPTIONS})",
        "caption_tags": f"select source_url, item_idx, array_to_string({_tags('caption')}, '|') as tags from ({_CAPTIONS})",
        "caption_category": f"select source_url, item_idx, {_CATEGORY} as category from (select source_url, item_idx, {_tags('caption')} as tg from ({_CAPTIONS}))",
        "enrich_captions": f"""with {_cosine(_CLEAN_CAPTIONS, 'caption', TOPIC, 5_000, False, False)}
select source_url, item_idx, round(case when regexp_matches(lower(caption), 'rewh|thatin|orre|ononst') then greatest(cosine, 0.4) else cosine end, 4) as score, {_CATEGORY} as category, array_to_string(tg, '|') as tags, array_to_string({_entities('caption', 3, True)}, '|') as entities
from (select source_url, item_idx, caption, cosine, {_tags('caption')} as tg from cos join it using (source_url, item_idx))""",
        "preprocess_manifest": "select page_id, 'JPEG' as format, 'Resize to 224x' || (page_id % 5 + 100) || ' (Lanczos); RGB channel normalization' || case when page_id % 5 = 0 then '; Histogram equalization' else '' end || case when page_id % 3 = 0 then '; Edge enhancement' else '' end || case when page_id % 2 = 0 then '; Grayscale conversion (3-ch)' else '' end || '; Export as JPEG (quality=95)' as steps from pages",
        "dictionary_entities": "select c_name as node, 'PERSON' as kind, count(*) as weight from customer group by c_name union all select n_name, 'GPE', count(*) from customer join nation on c_nationkey = n_nationkey group by n_name union all select c_mktsegment, 'PRODUCT', count(*) from customer group by c_mktsegment",
        "entity_nodes": f"select node, count(*) as weight from ({_MENTIONS}) group by node",
        "entity_edges": f"with {_EDGES} select * from ed",
        "pagerank": f"with {_ranks()} select node, round(pr * 1e6, 2) as pagerank from r10",
        "pagerank_converged": f"with {_converged()}",
        "edge_dataset": f"with {_ranks()} select 'Synthesized Graph' as source_url, src as source_node, dst as target_node, 'semantic_co_occurrence' as relationship_type, weight as edge_weight, round(a.pr, 4) as source_pagerank, round(b.pr, 4) as target_pagerank, round((a.pr + b.pr) / 2 * 100, 3) as score from ed join r10 a on a.node = src join r10 b on b.node = dst",
        "edge_view": f"with {_EDGES}, sq as (select src, dst, row_number() over (order by src, dst) as n from ed) select id, arg_max(g, n) as group from (select src as id, 1 as g, 2 * n as n from sq union all select dst, 2, 2 * n + 1 from sq) group by id".replace("as group", 'as "group"'),
        "edge_view_links": f"with {_EDGES} select src as source, dst as target, 1 as value from ed",
        "source_star_links": f"select 'hub' as source, url as target from ({_RANKED} order by page_id limit 50)",
        "selected_sources": "select page_id from pages where page_id % 4 in (0, 1)",
        "select_all_ids": "select distinct doc_id from documents union select doc_id from labels where quality = 1",
        "select_no_ids": "select distinct doc_id from labels where quality = 1 except select doc_id from labels where toxic = 1",
        "network_records": f"select 'network' as type, '' as content, 1.0::double as score, 'supplier:' || s_suppkey as source_url, s_name as name, s_nationkey::varchar as nation, '1.0' as relevance_score from supplier",
        "graph_records": f"with {_EDGES} select 'graph_' || substring(sha256('Synthesized Graph' || chr(1) || '0' || chr(1) || c), 1, 16) as id, 'graph' as type, c as content, weight::double as score from (select src || ' -> ' || dst as c, weight from ed)",
        "composed_paragraphs": rf"select 'https://doc.example.com/' || doc_id as source_url, sha1(t) as sha, length(t) as n from (select doc_id, regexp_replace(unnest(string_split(text, chr(10))), '{_TRIM}', '', 'g') as t from documents where text is not null and doc_id % 7 <> 0) where length(t) >= 50",
        "composed_images": """select 'https://shop.example.com/p/' || p_partkey || '.html' as source_url, 0 as item_idx, 'https://shop.example.com/' || case when p_partkey % 7 = 6 then 'p/' || p_partkey || '.jpg' else 'img/' || p_partkey || '.png' end as image_url, c as caption
from (select p_partkey, case p_partkey % 7 when 0 then ' ' || p_name || ' ' when 1 then '   ' when 2 then '      ' when 3 then 'abcde' when 4 then ' abcd ' when 5 then 'around' else p_name || p_brand end as c from part) where length(c) > 5""",
        "composed_audio": rf"select 'https://talk.example.com/' || k || '/index.html' as source_url, 0 as item_idx, 'https://talk.example.com/' || k || '/a/' || k || case when turn % 3 = 0 then '.mp3' else '.wav?x=1' end as audio_url, substring(regexp_replace(text, '{_TRIM}', '', 'g'), 1, 300) as context_transcript from (select conv_id || '-' || turn as k, turn, text from conversations where text is not null and turn % 3 < 2)",
        "composed_headings": "select 'https://c.example.com/' || c_custkey as source_url, i::int as item_idx, c_name as source_node, case when i = 0 then c_mktsegment else 'nation ' || c_nationkey end as target_node, 'contains/relates_to' as relationship_type from customer, (values (0), (1)) v(i) where c_custkey % 5 <> 0",
        "composed_tables": "select 'https://s.example.com/' || s_suppkey as source_url, 0 as item_idx, s_name as name, case when s_suppkey % 4 = 0 then '-' else s_nationkey::varchar end as nation, case when s_suppkey % 4 = 0 then '-' else 'x' end as third from supplier",
        "approximate_recall": "select true as recall_reached, 0::bigint as wrong",
        "media_manifest_audio": _recordings("'audio/audio_'", "case when contains(lower(url), '.wav') then 'wav' when contains(lower(url), '.ogg') then 'ogg' else 'mp3' end"),
        "media_manifest_spectrograms": _recordings("'spectrograms/audio_'", "'png'"),
        "media_manifest_files": _recordings("'audio/file_'", "case when contains(lower(url), 'png') then 'png' when contains(lower(url), 'webp') then 'webp' when contains(lower(url), 'wav') then 'wav' else 'mp3' end"),
        "concept_graph": f"select source_url || '/' || item_idx as source, unnest({_tags('caption')}) as target, 1 as value from ({_CAPTIONS}) union all select source_url || '/' || item_idx, unnest({_entities('caption', 3, True)}), 2 from ({_CAPTIONS})",
        "source_star": f"select url as id, domain as name, relevance_score * 10 as val from ({_RANKED} order by page_id limit 50) union all select 'hub', 'topic', 20.0",
        "audio_ext": f"""select page_id, case when contains(l, '.mp3') then 'mp3' when contains(l, '.wav') then 'wav' when contains(l, '.ogg') then 'ogg' else 'mp3' end as process,
case when contains(l, '.wav') then 'wav' when contains(l, '.ogg') then 'ogg' else 'mp3' end as download, {_EXT.format('jpg')} as generic_image, {_EXT.format('mp3')} as generic_audio
from (select page_id, lower(url || (['.mp3', '.WAV?x=1', '.ogg', '.png', ''])[page_id % 5 + 1]) as l from pages)""",
        "audio_scores": f"""with au as ({_AUDIO}), {_cosine(rf"select source_url, item_idx, transcript as text, audio_url from au where length(regexp_replace(transcript, '{_TRIM}', '', 'g')) > 0", 'text', TOPIC, 10_000, True, True)},
b as (select audio_url, min(round(cosine, 4)) as score from cos join it using (source_url, item_idx) where cosine >= 0.05 group by audio_url)
select source_url, item_idx, transcript, ext, case when score > 0 then score else 0.5 end as score from au left join b using (audio_url)""",
        "build_records": f"with {_KEPT} select 'text_' || substring(sha256(source_url || chr(1) || item_idx || chr(1) || text), 1, 16) as id, 'text' as type, text as content, 'general' as category, '' as tags, source_url, '{RUN_TS}' as ts, score from kept",
        "metadata_keys": f"select (row_number() over (order by first) - 1)::int as place, key from (select key, min(struct_pack(e := event_id, n := n)) as first from (select event_id, unnest(ks) as key, unnest(range(1, len(ks) + 1)) as n from (select event_id, ['source_url', 'timestamp', 'relevance_score'] || ks as ks from ({_EVENTS}))) group by key)",
        "flat_csv": """select 'network_' || substring(sha256('user:' || user_id || chr(1) || event_id || chr(1)), 1, 16) as id, 'network' as type, '' as content, 'user:' || user_id as "metadata.source_url",
'2026-01-01T00:00:00+00:00' as "metadata.timestamp", round(value, 2) as "metadata.relevance_score", coalesce(json_extract_string(props, '$.k'), '') as "metadata.k" from events""",
        "select_by_id": "select doc_id::varchar as id, lang, source from documents where doc_id in (select doc_id from labels where quality = 1)",
        "select_by_url": f"select url, page_id from pages where url in (select url from ({_RANKED} order by page_id limit 20))",
        "id_set_ops": "with g as (select distinct doc_id from labels where quality = 1), b as (select distinct doc_id from labels where toxic = 1) (select * from g except select * from b) union all (select * from b except select * from g)",
        "preview_top50": f"with {_KEPT} select text as content, source_url as source, case when score = 0 then '100' else round(score * 100, 0)::int::varchar end as percent from kept order by score desc, source_url, item_idx limit 50",
        "run_summary": f"with {_KEPT} select '{TOPIC}' as topic, 'text' as modality, (select count(*) from ({_RANKED} order by page_id limit 20)) as sources_used, count(*) as total_records, case when count(*) > 0 then '{RUN_TS}' end as created_at from kept",
        "stage_funnel": f"with {_KEPT}, ln as ({_LINES}) select 'clean' as stage, (select count(*) from ln) as rows_in, (select count(*) from it) as rows_out union all select 'score', (select count(*) from it), (select count(*) from sc) union all select 'exact', (select count(*) from sc), (select count(*) from kept)",
        "status_log_digest": _DIGEST,
        "status_log_stream": _DIGEST,
        "progress_scale": "select page_id, 30 + floor(floor((page_id % 41) / 40.0 * 100) * 0.3)::int as shown from pages",
        "selection_counts": "select count(*) filter (where s) as selected, count(*) as available, count(*) filter (where s) * 1.5 as estimate_s from (select case when page_id % 4 = 0 then true else page_id % 4 = 1 end as s from pages)",
        "document_files": "select format('documents/doc_{:04d}.txt', row_number() over (order by doc_id) - 1) as path, sha1(case when coalesce(text, '') = '' then 'No content.' else text end) as sha from documents",
        "media_manifest": "select path, url from (select page_id, format('images/image_{:04d}.webp', row_number() over (order by page_id) - 1) as path, url || '.webp' as url from pages) where page_id % 7 <> 0",
        "fetch_outcome": "select case when page_id % 11 = 0 then 'timeout' when page_id % 13 = 0 then null when contains(html, '<p') then 'ok' else 'error' end as status, count(*) as pages from pages group by 1",
        "stored_hits": f"select query, position, title, href from ({_STORED})",
        "stored_sources": r"""select query, title, url, ltrim(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), 'w.') as domain, greatest(round(1.0 - 0.02 * (k - 1), 3), 0.1)::double as relevance_score
from (select *, row_number() over (partition by query order by position) as k from (""" + _STORED + """)) where k <= 5""",
        "prominent_edges": f"with {_ranks()} select 'Synthesized Graph' as source_url, src as source_node, dst as target_node, 'semantic_co_occurrence' as relationship_type, weight as edge_weight, round(a.pr, 4) as source_pagerank, round(b.pr, 4) as target_pagerank, round((a.pr + b.pr) / 2 * 100, 3) as score from ed join r10 a on a.node = src join r10 b on b.node = dst where weight >= 2",
        "preview_without_content": """select substring('{"id":"network_' || substring(sha256(u || chr(1) || s_suppkey || chr(1)), 1, 16) || '","type":"network","content":"","tags":[],"entities":[],"category":"general","metadata":{', 1, 100) as content,
  case when s_suppkey % 3 = 0 then 's.example.com' when u = '' then 'Unknown' else u end as source, case when coalesce(score, 0) = 0 then '100' else round(score * 100, 0)::int::varchar end as percent
from (select s_suppkey, case s_suppkey % 3 when 0 then 'https://s.example.com/' || s_suppkey when 1 then '' else 'supplier ' || s_suppkey end as u, case s_suppkey % 4 when 0 then 0.0 when 1 then null else (s_suppkey % 100) / 100.0 end as score from supplier)
order by score desc nulls last, u, s_suppkey limit 50""",
        "typed_metadata": "select event_id, json_extract_string(props, '$.k') as k, json_extract_string(props, '$.k')::int as number, 'OBJECT<k: BIGINT>' as schema from events",
        "document_files_written": "select format('documents/doc_{:04d}.txt', row_number() over (order by doc_id) - 1) as path, sha1(case when coalesce(text, '') = '' then 'No content.' else text end) as sha from documents",
        "exports_reread": "select format, selected, s_name as name, 'text' as type, s_name as content from supplier, (values ('csv'), ('json'), ('zip')) f(format), (values (true), (false)) c(selected) where not selected or s_name like '%1'",
        "incremental_dedup": f"select source_url from (select source_url, row_number() over (partition by {_hash('text')} order by doc_id % 2, source_url) as r from ({_WHOLE})) where r = 1",
    }
