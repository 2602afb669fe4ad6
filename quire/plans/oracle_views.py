"""DuckDB definitions of the listing views, used by the oracle SQL.

The oracle is an independent formulation: these views are plain SQL over
the pre-registered driver tables, and each oracle query is written against
them with its own SQL (windows, sub-queries) rather than mirroring the
Spark plan.
"""

from __future__ import annotations

VIEWS = {
    "c": """
select concat_ws('-', cast(l_orderkey as varchar), cast(l_linenumber as varchar), cast(l_partkey as varchar),
         cast(l_suppkey as varchar),
         cast(year(l_shipdate)*10000+month(l_shipdate)*100+day(l_shipdate) as varchar)) as sku_id,
       case s_nationkey % 3 when 0 then 'sg' when 1 then 'my' else 'ph' end as country,
       p_name as title, p_type as category_lvl_1, p_brand as category_lvl_2,
       case when p_size % 10 = 0 then null else concat('size ', cast(p_size as varchar)) end as category_lvl_3,
       l_extendedprice as price,
       case l_returnflag when 'N' then null when 'A' then 'local' else 'international' end as product_type
from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey""",
    "d": """
select concat('D', lpad(cast(d.doc_id as varchar), 9, '0'), lang) as sku_id, lang as country,
       split_part(text, chr(10), 1) as title,
       lang as category_lvl_1, source as category_lvl_2, concat('q ', cast(n_chars % 7 as varchar)) as category_lvl_3,
       text as short_description, cast(n_chars as double) as price,
       quality as conciseness, 1 - toxic as clarity,
       case when doc_id % 5 = 0 then 'tst' else 'trn' end as split
from documents d left join labels using (doc_id)""",
    "h": """
select concat('P', cast(page_id as varchar)) as sku_id,
       regexp_extract(html, '<title>([^<]*)</title>', 1) as title, html as short_description,
       regexp_extract(html, '<html lang="([a-z]*)"', 1) as country,
       regexp_extract(url, '^https?://([^/]+)', 1) as category_lvl_1
from pages""",
    "p": """
select concat('D', lpad(cast(d.doc_id as varchar), 9, '0'), lang) as sku_id, m as model,
       cast(doc_id % 10 as int) as fold,
       cast((doc_id * (7 + 4 * m) + n_chars) % 1000 as double) / 1000.0 as pred
from documents d, (values (1), (2), (3)) k(m)""",
    "p2": """
select concat('D', lpad(cast(d.doc_id as varchar), 9, '0'), lang) as sku_id, m as model,
       cast(doc_id % 10 as int) as fold,
       cast((doc_id * (5 + 6 * m) + 3 * n_chars) % 1000 as double) / 1000.0 as pred
from documents d, (values (1), (2), (3)) k(m)""",
    "t": """
select concat('V', cast(conv_id as varchar)) as sku_id,
       '<ul>' || string_agg('<li>' || role || ' : ' || text || '</li>', '' order by turn, role, text) || '</ul>' as short_description
from conversations group by conv_id""",
    "tt": """
select sku_id, unnest(regexp_split_to_array(trim(regexp_replace(lower(regexp_replace(title, '[^a-zA-Z]', ' ', 'g')), ' +', ' ', 'g')), ' ')) as word
from d where trim(regexp_replace(title, '[^a-zA-Z]', ' ', 'g')) <> ''""",
    "v": """
select w.word, e.embedding as vec
from (select word, row_number() over (order by count(*) desc, word) - 1 as vec_id from tt group by word) w
join embeddings e on e.vec_id = w.vec_id""",
}

DEPENDS = {"tt": ["d"], "v": ["tt"]}


def views(*names: str) -> str:
    """``WITH`` clause defining the named views and their dependencies."""
    order: list[str] = []

    def add(n):
        for dep in DEPENDS.get(n, []):
            add(dep)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "with " + ",\n".join(f"{n} as ({VIEWS[n]})" for n in order) + "\n"
