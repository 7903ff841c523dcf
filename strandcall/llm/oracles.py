"""The same results in DuckDB's SQL, where SQL can express them."""

from __future__ import annotations

from strandcall.llm.common import LOWER, UPPER

OP1 = r"""
with docs as (
    select row_number() over () as k, doc_id, source, coalesce(cast(doc_id as varchar), '') as id,
        cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
        substr(md5(concat('mix|', coalesce(cast(doc_id as varchar), ''), '|', md5(coalesce(text, '')))), 1, 13) as draw
    from documents
), sized as (
    select *, (cast(cast('0x' || draw as bigint) as double) + 0.5) / 4503599627370496.0::double as u,
        4 + case when size > 0 then length(bin(size)) else 0 end as grade
    from docs
), sources as (
    select source, cast(sum(size) as bigint) as source_size,
        [3, 1, 2][(row_number() over (order by source is null, source) - 1) % 3 + 1] as weight
    from sized group by source
), stops as (
    select *, source_size * 2 as most,
        cast(sum(source_size) over () as bigint)::double * 1.5::double as budget,
        cast(coalesce(sum(source_size * 2) over before, 0) as bigint) as stopped,
        cast(sum(weight) over () - coalesce(sum(weight) over before, 0) as bigint) as sharing
    from sources
    window before as (order by (source_size * 2)::double / weight, source is null, source
                      rows between unbounded preceding and 1 preceding)
), levels as (
    select *, (budget - stopped) / sharing::double as level from stops
), targets as (
    select source, source_size, least(coalesce((
        select level from levels where level * weight <= most order by stopped, level limit 1
    ) * weight, most::double), most::double) as target
    from levels
), grades as (
    select source, grade, cast(sum(size) as bigint) as words from sized group by source, grade
), open_grades as (
    select g.*, t.source_size, t.target,
        cast(coalesce(sum(words) over before, 0) as bigint) as filled,
        cast(sum(words * grade) over (partition by g.source) - coalesce(sum(words * grade) over before, 0) as bigint) as free
    from grades g join targets t on g.source is not distinct from t.source
    window before as (partition by g.source order by grade desc rows between unbounded preceding and 1 preceding)
), rates as (
    select *, case when free > 0 then (target - filled * 2) / free::double end as rate from open_grades
), copied as (
    select *, case when target > 0 then least(coalesce(min(
        case when rate * grade <= 2 then {'f': filled, 'g': -grade, 'rate': rate} end
    ) over (partition by source).rate * grade, 2.0::double), 2.0::double) else 0.0::double end as expected
    from rates
), drawn as (
    select s.*, c.source_size, c.target, cast(floor(expected) as bigint) as whole, expected - floor(expected) as part
    from sized s join copied c on s.source is not distinct from c.source and s.grade = c.grade
), ordered as (
    select *, u / (1 - u) * ((1 - part) / part) as odds,
        target - sum(size * whole) over (partition by source) as rest
    from drawn
), placed as (
    select *, coalesce(sum(size) over (partition by source order by odds / (1 + odds), draw, id
        rows between unbounded preceding and 1 preceding), 0) + size / 2 <= rest as more
    from ordered where part > 0 and size > 0
    union all select *, false from ordered where part = 0 or size = 0
)
select doc_id, size, source_size, target, cast(size * (whole + more::bigint) as bigint) as taken, source,
    cast(whole + more::bigint as bigint) as copies
from placed
"""

OP6 = rf"""
with docs as (
    select row_number() over () as k, doc_id,
        coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w
    from documents
), items as (
    select coalesce(cast(item_id as varchar), '') as item_id,
        coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w
    from benchmark
), sized as (
    select item_id, w, least(len(w), 13) as size from items where len(w) > 0
), windows as (
    select distinct item_id, size, array_to_string(w[s:s + size - 1], ' ') as phrase
    from (select item_id, w, size, unnest(range(1, len(w) - size + 2)) as s from sized)
), places as (
    select k, size, s, array_to_string(w[s:s + size - 1], ' ') as phrase
    from (select k, w, size, unnest(range(1, len(w) - size + 2)) as s
          from docs, (select distinct size from windows) where len(w) >= size)
), hits as (
    select k, s, size, item_id from places join windows using (size, phrase)
), words as (
    select k, count(distinct place) as n_hit
    from (select k, unnest(range(s, s + size)) as place from hits) group by k
), ids as (
    select k, count(distinct item_id) as n_items,
        array_to_string(list_sort(list(distinct item_id)), ',') as item_ids
    from hits group by k
)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
    cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(item_ids, '')) as items_sha256,
    coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from docs left join words using (k) left join ids using (k)
"""

OP8 = rf"""
with parsed as (
    select row_number() over () as k, page_id,
        coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '{UPPER}', '{LOWER}'), '') as host,
        coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path
    from pages
), rules(host, path, verdict) as (
    values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
        ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), fitting as (
    select k, r.host || r.path as rule, r.verdict,
        row_number() over (partition by k order by length(r.host || r.path) desc, length(r.host) desc) as place
    from parsed p join rules r
        on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path)
), toxic as (
    select distinct cast(doc_id as varchar) as number from labels where toxic = 1
), listed as (
    select distinct host, path from parsed join toxic on regexp_extract(path, '0*([0-9]+)(?:\.html?)?/?$', 1) = number
)
select page_id, p.host, p.path, f.rule,
    coalesce(f.verdict, case when l.host is not null then 'block' else 'allow' end) as verdict
from parsed p left join fitting f on p.k = f.k and f.place = 1
    left join listed l on p.host = l.host and p.path = l.path
"""

OP13 = """
with finite as (
    select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, embedding
    from embeddings
    where label is not null and len(embedding) > 0
        and len(list_filter(embedding, lambda c: c is null or isnan(c) or isinf(c))) = 0
), lengths as (
    select len(embedding) as size from embeddings
    where len(embedding) > 0 and len(list_filter(embedding, lambda c: c is null or isnan(c) or isinf(c))) = 0
    group by len(embedding) order by count(*) desc, size desc limit 1
), vectors as (
    select id, label, list_transform(embedding, lambda c: floor(256 * cast(c as double))) as vector
    from finite where len(embedding) = (select size from lengths)
), anchors as (
    select row_number() over () as k, * from (select distinct id, label, vector from vectors where id % 50 = 0)
), scored as (
    select k, a.id as anchor_id, b.id as other, a.label = b.label as alike, a.id is distinct from b.id as apart,
        cast(list_dot_product(a.vector, b.vector) as bigint) as score
    from anchors a, vectors b
), positives as (
    select k, anchor_id, other as positive_id, score as positive_score,
        row_number() over (partition by k order by score desc, other nulls last) as place
    from scored where alike and apart
    qualify place <= 5
), ranked as (
    select p.anchor_id, p.positive_id, n.other as negative_id, p.positive_score, n.score as negative_score,
        row_number() over (partition by p.k, p.place order by n.score desc, n.other nulls last) as rank
    from positives p join scored n
        on p.k = n.k and not n.alike and 50 * p.positive_score <= 100 * n.score and 100 * n.score <= 95 * p.positive_score
)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score
from ranked where rank <= 3
"""

ORACLES: dict[str, str] = {
    "op1_pareto_mix": OP1,
    "op6_phrase_index": OP6,
    "op8_url_bloom": OP8,
    "op13_anchor_lists": OP13,
}
