"""One query for each operator that plain SQL says best, over the driver's tables."""

STOPS = "('the', 'of', 'and', 'in', 'a', 'to', 'is', 'der', 'die', 'das', 'und', 'le', 'la', 'les', 'de', 'et', 'el', 'los', 'las', 'que')"
STOP_LIST = STOPS.replace("(", "array(")
WORDS = "fl(ssplit(lower(text), ' '), w -> w <> '')"
#: Orders as a group with its list of parts, by line.
LISTS = "(select l_orderkey as k, alistby(l_partkey, l_linenumber * 1000000 + l_partkey) as a from lineitem group by l_orderkey)"

SQL = {
    # filters and projections
    "FIL1": "select doc_id, n_chars from documents where text is not null and lang is not null",
    "FIL2": "select doc_id from documents where not coalesce(lower(text) like '%license%', false)",
    "FIL3": "select page_id from pages where not coalesce(lower(html) like '%review%', false)",
    "FIL4": "select c_custkey from customer where not coalesce(c_mktsegment in ('BUILDING', 'MACHINERY'), false) and not coalesce(c_nationkey in (1, 2, 3), false)",
    "FIL5": "select p_partkey, p_name from part where not coalesce(has(lower(p_name), 'ring|bolt|blue'), false)",
    "FIL6": "select distinct w from (select unnest(ssplit(p_name, ' ')) as w from part) x where w = lower(w) and w <> upper(w)",
    "FIL7": "select distinct w from (select unnest(ssplit(text, ' ')) as w from conversations) x where w <> '' and not has(w, '^[0-9]+$') and not has(w, '^ORF[0-9]+') and not has(w, '^S[0-9]+$') and not has(lower(w), '^cas[0-9]+$')",
    "FIL8": "select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_nationkey = 3)",
    "FIL9": "select k, ordered(fl(ec, e -> has(e, '^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$'))) as ec from (select l_orderkey as k, alist(case when l_linenumber % 2 = 0 then concat(textof(l_linenumber), '.1.', textof(l_suppkey % 5), '.', textof(l_partkey % 7)) else concat(textof(l_linenumber), '.1') end) as ec from lineitem group by l_orderkey) x where asize(fl(ec, e -> has(e, '^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$'))) > 0",
    "FIL10": "select c_custkey as customer_id, c_name as name from customer",
    "FIL11": "select k, case when asize(fl(a, e -> e % 3 = 0)) > 0 then asize(fl(a, e -> e % 3 = 0)) end as n from " + LISTS + " x",
    "FIL14": "select o_orderkey from orders o where not exists (select 1 from lineitem l where l.l_orderkey = o.o_orderkey and l.l_returnflag = 'R')",
    # joins
    "JN1": "select coalesce(c_custkey, o_custkey) as k, n, c_name from customer full join (select o_custkey, count(*) as n from orders group by o_custkey) o on c_custkey = o_custkey",
    "JN2": "select c_custkey, c_name, orders from customer left join (select o_custkey, alistby(o_orderkey, o_orderkey) as orders from orders group by o_custkey) o on c_custkey = o_custkey",
    "JN3": "select o_orderkey, l_linenumber, l_partkey from orders join lineitem on o_orderkey = l_orderkey",
    "JN4": "select c.c_custkey, s.s_suppkey from customer c left join supplier s on replace(c.c_name, 'Customer', 'Supplier') = s.s_name",
    "JN5": "select g.l_suppkey as gene, r.l_partkey as reaction, count(*) as n from (select distinct l_suppkey, l_orderkey from lineitem) g join (select distinct l_partkey, l_orderkey from lineitem) r on g.l_orderkey = r.l_orderkey group by g.l_suppkey, r.l_partkey",
    "JN6": "select n_name, s_suppkey from (select * from nation where n_nationkey < 15) n full join (select * from supplier where s_nationkey > 5) s on n_nationkey = s_nationkey",
    "JN7": "select p_partkey, l_orderkey from (select * from part where p_partkey in (select l_partkey from lineitem where l_quantity > 45)) p left join (select * from lineitem where l_discount > 0.08) l on p_partkey = l_partkey",
    "JN8": "select o.o_orderkey, o.o_custkey, l.l_returnflag from orders o left join (select distinct l_orderkey, l_returnflag from lineitem) l on o.o_orderkey = l.l_orderkey",
    "JN9": "select c_custkey, coalesce(n.n_name, c_mktsegment) as label from customer left join (select * from nation where n_regionkey = 1) n on c_nationkey = n_nationkey",
    "JN10": "select s_suppkey, n_name, r_name from supplier left join nation on s_nationkey = n_nationkey left join region on n_regionkey = r_regionkey",
    "JN11": "select n_nationkey, argmax(name, priority) as name from (select n_nationkey, n_name as name, 1 as priority from nation union all select n_nationkey, upper(concat(n_name, '_FIXED')) as name, 2 as priority from nation where n_nationkey % 4 = 0) x group by n_nationkey",
    "JN12": "select l_orderkey, argmin(p_brand, l_linenumber * 1000000 + l_partkey) as first_brand from lineitem join part on l_partkey = p_partkey where p_size > 25 group by l_orderkey",
    "JN13": "select l_suppkey, ordered(alist(distinct p_brand)) as brands from lineitem join part on l_partkey = p_partkey group by l_suppkey",
    "JN14": "select p_partkey, n_name from (select distinct p_partkey, unnest(flat(tr(seq(1, length(s)), i -> tr(seq(i, length(s)), j -> substr(s, cast(i as int), cast(j - i + 1 as int)))))) as piece from (select p_partkey, concat('NATION_', textof(p_size)) as s from part) x) y join (select distinct n_name from nation) n on piece = n_name",
    "JN16": "select w, coalesce(a.id, b.id) as id, coalesce(a.name, b.name, w) as name from (select distinct w from (select unnest(ssplit(concat(p_name, ' rings bolts'), ' ')) as w from part) y) x left join (select w2, min(id) as id, min(w2) as name from (select unnest(ssplit(p_name, ' ')) as w2, p_partkey as id from part) z group by w2) a on x.w = a.w2 left join (select w2, min(id) as id, min(w2) as name from (select unnest(ssplit(p_name, ' ')) as w2, p_partkey as id from part) z group by w2) b on a.w2 is null and substr(x.w, 1, length(x.w) - 1) = b.w2 and x.w like '%s'",
    "JN17": "select p_partkey, case when p_type in ('PROMO', 'SMALL') then p_type else coalesce(t.r_name, p_type) end as name from part left join (select r_name, r_regionkey from region) t on p_size % 7 = t.r_regionkey",
    "JN19": "select l_orderkey, l_linenumber from (select l_orderkey, l_linenumber, l_returnflag, max(case when l_returnflag = 'R' then 1 else 0 end) over (partition by l_orderkey) as any_r from lineitem) x where any_r = 0 or l_returnflag = 'R'",
    # aggregations
    "AGG1": "select event_type, count(*) as n from events where event_type is not null group by event_type",
    "AGG2": "select l_orderkey, alistby(l_partkey, l_linenumber * 1000000 + l_partkey) as parts from lineitem group by l_orderkey",
    "AGG3": "select l_suppkey % 50 as g, ordered(alist(distinct l_partkey)) as parts from lineitem group by l_suppkey % 50",
    "AGG4": "select k % 100 as g, count(*) as lists, cast(sum(asize(a)) as bigint) as members from " + LISTS + " x group by k % 100",
    "AGG5": "select l_orderkey, ajoin(alistby(textof(l_partkey), l_linenumber * 1000000 + l_partkey), '') as joined from lineitem group by l_orderkey",
    "AGG6": "select l_partkey, count(distinct l_orderkey) as papers, count(distinct l_suppkey) as reactions from lineitem group by l_partkey",
    "AGG7": "select l_linenumber, sum(case when l_returnflag = 'A' then 1 else 0 end) as a, sum(case when l_returnflag = 'N' then 1 else 0 end) as n, sum(case when l_returnflag = 'R' then 1 else 0 end) as r from lineitem group by l_linenumber",
    "AGG8": "select l_returnflag, count(*) as n, round(cast(count(*) as double) / (select count(*) from lineitem), 6) as share from lineitem group by l_returnflag",
    "AGG9": "select count(*) as total, sum(case when lower(text) like '%license%' then 1 else 0 end) as found, round(cast(sum(case when lower(text) like '%license%' then 1 else 0 end) as double) / count(*), 6) as rate from documents",
    "AGG10": "select sum(asize(aminus(a, b))) as removed, sum(asize(aminus(b, a))) as added, sum(case when asize(b) < asize(a) then 1 else 0 end) as reduced, sum(case when asize(b) = asize(a) then 1 else 0 end) as unchanged from (select " + WORDS + " as a, fl(" + WORDS + ", w -> not acontains(" + STOP_LIST + ", w)) as b from documents) x",
    "AGG11": "select min(n_chars) as lo, max(n_chars) as hi, count(*) as n, count(distinct source) as sources, count(distinct lang) as langs from documents",
    "AGG12": "select k, count(distinct p_partkey) as n, argmin(w, p_partkey * 100 + pos) as label from (select p_partkey, 1 as pos, p_brand as w, lower(p_brand) as k from part union all select p_partkey, 2 as pos, p_type as w, lower(p_type) as k from part) x group by k",
    "AGG13": "select sum(case when d = 'up' then 1 else 0 end) as up, sum(case when d = 'down' then 1 else 0 end) as down, sum(case when d = 'other' then 1 else 0 end) as other from (select case event_type when 'purchase' then 'up' when 'signup' then 'up' when 'error' then 'down' else 'other' end as d from events) x",
    "AGG14": "select l_orderkey, argmin(l_quantity, l_linenumber * 100000000000.0 + l_partkey * 100 + l_quantity) as first_quantity, ordered(alist(distinct l_suppkey)) as suppliers from lineitem group by l_orderkey",
    "AGG15": "select w, n from (select w, count(*) as n, row_number() over (order by count(*) desc, w) as r from (select unnest(" + WORDS + ") as w from conversations) x where not w in " + STOPS + " group by w) y where r <= 20",
    "AGG16": "select e.k, ordered(alist(distinct n.k2)) as reach from (select distinct l_suppkey as k, l_orderkey as o from lineitem) e join (select distinct l_suppkey as k2, l_orderkey as o from lineitem) n on e.o = n.o group by e.k",
    "AGG17": "select l_suppkey, l_partkey from lineitem group by l_suppkey, l_partkey having sum(case when l_orderkey in (select l_orderkey from lineitem group by l_orderkey having count(distinct l_suppkey) = 1) then 1 else 0 end) > 0",
    "AGG18": "select l_partkey from lineitem where l_returnflag in ('A', 'N', 'R') group by l_partkey having count(distinct l_returnflag) = 3",
    # order-dependent
    "WIN1": "select distinct c_nationkey, c_mktsegment, dense_rank() over (partition by c_nationkey order by first) as code from (select c_nationkey, c_mktsegment, min(c_custkey) over (partition by c_nationkey, c_mktsegment) as first from customer) x",
    "WIN4": "select o_custkey, o_orderkey from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as r from orders) x where r = 1",
    "WIN5": "select distinct l_returnflag, l_linestatus, l_linenumber from lineitem",
    "WIN6": "select l.l_orderkey, l.l_linenumber, l.l_quantity from lineitem l join (select l_orderkey, min(l_linenumber) as m from lineitem group by l_orderkey) f on l.l_orderkey = f.l_orderkey and l.l_linenumber = f.m",
    "WIN7": "select l_partkey, count(*) as n from (select distinct l_partkey, l_orderkey from lineitem) x group by l_partkey",
    "WIN8": "select conv_id, turn, tr(seq(1, asize(w) - 1), i -> concat(at(w, cast(i as int)), ' ', at(w, cast(i + 1 as int)))) as pairs from (select conv_id, turn, " + WORDS + " as w from conversations) x where asize(w) > 1",
    # top-k
    "TOP1": "select w, n from (select w, count(*) as n, row_number() over (order by count(*) desc, w) as r from (select unnest(ssplit(lower(p_name), ' ')) as w from part) x group by w) y where r <= 300",
    "TOP2": "select source, n, greatest(3.0, round(100.0 * n / m, 4)) as width from (select source, n, cast(max(n) over () as double) as m, row_number() over (order by n desc, source) as r from (select source, cast(count(*) as double) as n from documents group by source) x) y where r <= 5",
    "TOP3": "select w, n from (select w, count(*) as n, row_number() over (order by count(*) desc, w) as r from (select unnest(" + WORDS + ") as w from documents) x where not w in " + STOPS + " group by w) y where r <= 150",
    "TOP4": "select l_partkey, n, row_number() over (order by n, l_partkey desc) as place from (select l_partkey, n, row_number() over (order by n desc, l_partkey) as r from (select l_partkey, count(*) as n from lineitem group by l_partkey) x) y where r <= 25",
    "TOP8": "select doc_id, w from (select doc_id, w, row_number() over (partition by doc_id order by case when w like 'the%' then 0 else 1 end, length(w) desc, w) as r from (select distinct doc_id, w from (select doc_id, unnest(" + WORDS + ") as w from documents) y) x) z where r = 1",
    # sets
    "SET1": "select c_custkey as id, c_name as name from customer union all select s_suppkey as id, s_name as name from supplier",
    "SET2": "select k, argmax(v, p) as v from (select c_nationkey as k, c_custkey as v, c_custkey as p from customer union all select s_nationkey as k, s_suppkey as v, 10000000 + s_suppkey as p from supplier) x group by k",
    "SET3": "select k, ordered(aor(coalesce(fl(a, e -> e % 2 = 0), array()), coalesce(fl(a, e -> e % 3 = 0), array()))) as u from " + LISTS + " x",
    "SET4": "(select c_nationkey as k from customer intersect select s_nationkey as k from supplier) except select n_nationkey as k from nation where n_regionkey = 2",
    "SET5": "select k from (select o_custkey as k from orders where o_orderstatus = 'F' union select o_custkey as k from orders where o_orderstatus = 'O') x",
    # text
    "STR1": "select doc_id, rx(rx(text, '<[^>]*>', ''), '[^a-zA-Z0-9]', ' ') as plain from documents",
    "STR2": "select doc_id, trim(coalesce(source, '')) as source from documents",
    "STR3": "select doc_id, ajoin(fl(ssplit(text, ' '), w -> not acontains(" + STOP_LIST + ", lower(w))), ' ') as kept from documents",
    "STR12": "select doc_id, lower(concat_ws(' ', textof(doc_id), rx(text, '</?([biBI]|[sS][uU][pP]|[sS][uU][bB])>', ''), lang, source)) as search from documents",
    "STR13": "select page_id, concat('https://records.example.org/', textof(page_id), '/') as link from pages",
    "STR14": "select page_id, case when doi = '10.1000/7' then '10.1000/77' else doi end as doi from (select page_id, rx(rx(rx(rx(d, '^.*doi:', ''), '^.*doi/', ''), '^.*doi[.]org/', ''), '^[''\"]+|[''\"]+$', '') as doi from (select page_id, case when page_id % 4 = 0 then concat('https://doi.org/10.1000/', textof(page_id)) when page_id % 4 = 1 then concat('doi:10.1000/', textof(page_id)) when page_id % 4 = 2 then concat('\"x/doi/10.1000/', textof(page_id), '\"') else concat('10.1000/', textof(page_id)) end as d from pages) x) y",
    "STR15": "select source, concat('(', ajoin(tr(langs, x -> concat('(', x, '[LANG])')), ' OR '), ')') as any_of, ajoin(tr(langs, x -> concat('(', x, ')')), ' AND ') as all_of, concat(' NOT (', ajoin(tr(langs, x -> concat('(', x, '[JOUR])')), ' OR '), ')') as none_of from (select source, ordered(alist(distinct lang)) as langs from documents group by source) x",
    "STR16": "select o_orderkey, coalesce(y, rextract(m, '^([^ ]*)', 1), a, case when cast(rextract(e, '^[^.]*[.][^.]*[.]([0-9]+)', 1) as int) between 1910 and 2100 then rextract(e, '^[^.]*[.][^.]*[.]([0-9]+)', 1) end) as year from (select o_orderkey, case when o_orderkey % 4 = 0 then textof(year(o_orderdate)) end as y, case when o_orderkey % 4 = 1 then concat(textof(year(o_orderdate)), ' Jan-Feb') end as m, case when o_orderkey % 4 = 2 then textof(year(o_orderdate)) end as a, concat('10.j.', textof(1900 + o_orderkey % 300), '.2') as e from orders) x",
    "STR17": "select c_custkey, rx(c_name, '^[Custome#0]+', '') as id from customer",
    "STR21": "select p_partkey, rx(rx(rx(concat(p_name, ' acid'), 'ic acid$', 'ate'), ' acid$', 'ate'), 'amino$', 'amino acid') as name from part",
    "STR42": "select w, case when has(w, 'ies$') then rx(w, 'ies$', 'y') when has(w, '(ss|us|is)$') or length(w) < 4 then w when has(w, 's$') then rx(w, 's$', '') else w end as one from (select distinct unnest(ssplit(lower(text), ' ')) as w from conversations) x where has(w, '^[a-z]+$')",
    "STR44": "select p_partkey, concat(upper(substr(p_type, 1, 1)), lower(substr(p_type, 2))) as title from part",
    "STR45": "select p_partkey, rextract(rel, '^([A-Za-z0-9_#-]+) *-> *(.+)$', 1) as gene, rextract(rel, '^([A-Za-z0-9_#-]+) *-> *(.+)$', 2) as action from (select p_partkey, concat(p_brand, ' ARROW ', p_type) as rel from part) x",
    "STR48": "select c_custkey, rx(trim(rx(c_name, '#', ' ')), ' +', ' ') as name from customer",
    # arrays
    "ARR1": "select p_partkey, fl(tr(ssplit(concat(replace(p_name, ' ', ', '), ', ,'), ','), x -> trim(x)), x -> x <> '') as parts from part",
    "ARR2": "select user_id, ordered(aset(tr(ts, x -> case when x in ('purchase', 'signup') then x else 'Other' end))) as d from (select user_id, alist(event_type) as ts from events group by user_id) x",
    "ARR4": "select p_partkey, unnest(ssplit(p_name, ' ')) as w from part",
    "ARR10": "select k, fl(a, e -> not acontains(array(1, 2, 3, 5, 8, 13), e % 14)) as kept from " + LISTS + " x",
    "ARR11": "select doc_id, ajoin(fl(ssplit(text, ' '), w -> length(w) > 1), ' ') as kept from documents",
    "ARR12": "select p_partkey, case when p_type = 'PROMO' then array('promo', 'sale') when p_size < 10 then array('small') else array(lower(p_type)) end as categories from part",
    "ARR13": "select k, ordered(aset(tr(a, e -> e % 10))) as u from " + LISTS + " x",
    "ARR15": "select k, ordered(case when asize(fl(ec, e -> length(e) > 5)) > 0 then fl(ec, e -> length(e) > 5) else ec end) as ec from (select l_orderkey as k, alist(case when l_linenumber % 2 = 0 then concat(textof(l_linenumber), '.1.2.', textof(l_partkey % 7)) else concat(textof(l_linenumber), '.1') end) as ec from lineitem group by l_orderkey) x",
    "ARR16": "select k, asize(aset(a)) as total, asize(aset(aand(a, b))) as matched, asize(aminus(a, b)) as unmatched, case when asize(aset(a)) = 0 then 0.0 else half_even(cast(asize(aset(aand(a, b))) as double) / asize(aset(a)), 3) end as fraction from (select k, a, tr(a, e -> e - e % 2) as b from " + LISTS + " y) x",
    "ARR17": "select k, asize(aminus(a, array(1, 2, 3))) as score from " + LISTS + " x",
    "ARR18": "select k, fl(a, e -> e <> at(a, 1)) as others from " + LISTS + " x",
    "ARR19": "select l_partkey, ajoin(ordered(alist(distinct textof(l_suppkey))), ';') as refs from lineitem group by l_partkey",
    "ARR20": "select o_custkey, argmax(o_orderkey, o_orderkey) as last_order from orders group by o_custkey",
    "ARR21": "select n_nationkey, tr(seq(0, 9), i -> concat(n_name, textof(i))) as variants from nation",
    "ARR22": "select distinct w from (select unnest(ssplit(text, ' ')) as w from conversations) x where w <> '' and not has(w, '^[a-zA-Z][0-9]{1,2}$') and not has(w, '^[ivxIVX]+$') and not lower(w) in " + STOPS,
    "ARR23": "select l_suppkey % 20 as paper, ordered(alist(distinct concat(textof(l_partkey % 50), ' -> ', l_returnflag))) as relations from lineitem group by l_suppkey % 20",
    "ARR24": "select p_brand, ordered(fl(names, x -> asize(fl(names, y -> length(y) > length(x) and ordinal(y, x) > 0)) = 0)) as kept from (select p_brand, alist(distinct p_name) as names from part group by p_brand) z",
    # dates, numbers, conditions
    "MTH1": "select y, q, concat(textof(y), '/', case q when 1 then '01/01' when 2 then '04/01' when 3 then '07/01' else '10/01' end) as start from (select 2000 + r_regionkey as y, unnest(seq(1, 4)) as q from region) x",
    "MTH2": "select doc_id, try_cast(substr(source, 4) as int) as number from documents",
    "MTH3": "select l_orderkey, case when sum(l_quantity) = 0 then 0.0 else half_even(count(*) / sum(l_quantity), 3) end as fraction from lineitem group by l_orderkey",
    "MTH4": "select l_orderkey, l_linenumber, case when l_discount = 0 then 0 when l_discount > 0.05 then 2 else 1 end as presence from lineitem",
    "MTH6": "select user_id, case when count(distinct event_type) > 1 then 'mixed' else min(event_type) end as look from events group by user_id",
    "MTH7": "select l_suppkey, max(s_name) as name, count(*) as n from lineitem left join supplier on l_suppkey = s_suppkey group by l_suppkey",
    # models' metrics
    "ML4": "select round(cast(sum(case when quality = toxic then 1 else 0 end) as double) / count(*), 6) as accuracy, round(cast(sum(quality * toxic) as double) / sum(toxic), 6) as prec, round(cast(sum(quality * toxic) as double) / sum(quality), 6) as rec from labels",
    "ML5": "select sum(case when quality = 1 and toxic = 1 then 1 else 0 end) as tp, sum(case when quality = 1 and toxic = 0 then 1 else 0 end) as fn, sum(case when quality = 0 and toxic = 1 then 1 else 0 end) as fp, sum(case when quality = 0 and toxic = 0 then 1 else 0 end) as tn from labels",
    "ML7": "select quality, sum(case when toxic = 0 then 1 else 0 end) as t0, sum(case when toxic = 1 then 1 else 0 end) as t1 from labels group by quality",
    # composites
    "Q1": "select conv_id, coalesce(u, a, s) as found, case when u is not null then 'user' when a is not null then 'assistant' when s is not null then 'system' else 'none' end as source from (select conv_id, min(case when role = 'user' and lower(text) like '%the%' then turn end) as u, min(case when role = 'assistant' and lower(text) like '%the%' then turn end) as a, min(case when role = 'system' then turn end) as s from conversations group by conv_id) x",
    "Q11": "select o_orderpriority, 'abundance' as kind, cast(count(*) as double) as v from orders group by o_orderpriority union all select o_orderpriority, o_orderstatus as kind, round(cast(count(*) as double) / max(t), 6) as v from (select o_orderpriority, o_orderstatus, count(*) over (partition by o_orderpriority) as t from orders) x group by o_orderpriority, o_orderstatus",
    # the rest
    "RST2": "select k, min(page_id) as first, count(*) as n from (select page_id, ssplit(url, '/')[SUB2] as k from pages) x group by k",
    "RST4": "select doc_id, lower(lang) as lang, 1 as class from documents where doc_id in (select doc_id from labels where quality = 1)",
    "RST6": "select round(100.0 * sum(case when quality = toxic then 1 else 0 end) / count(*), 4) as accuracy, sum(case when quality = 1 and toxic = 1 then 1 else 0 end) as hits from labels",
    "RST8": "select c_custkey, case when asize(orders) > 0 then orders end as orders from (select c_custkey, fl(alistby(coalesce(o_orderkey, -1), coalesce(o_orderkey, -1)), x -> x >= 0) as orders from customer left join orders on c_custkey = o_custkey group by c_custkey) x",
    "RST10": "select p_partkey from part where not has(p_name, 'ring$')",
    "RST12": "select n_nationkey, concat('https://example.org/get/', lower(n_name)) as link from nation",
    "RST15": "select concat(prefix, w) as action from (select distinct unnest(ssplit(p_name, ' ')) as w from part) x, (select unnest(array('over', 'under', 're', 'co', 'non', 'down', 'up')) as prefix) y",
    "RST21": "select conv_id, turn from (select conv_id, turn, " + WORDS + " as w from conversations) x where asize(aand(w, " + STOP_LIST + ")) > 0",
    "RST23": "select distinct n_nationkey, unnest(ssplit(concat(n_name, ';', textof(n_regionkey)), ';')) as ec from nation",
    "RST26": "select k, case when asize(aminus(a, array(1, 2))) = 0 then 1 else 0 end as within, case when asize(aminus(array(1, 2), a)) = 0 then 1 else 0 end as holds from " + LISTS + " x",
    "RST27": "select l_orderkey, max(case when l_tax = 0 then 0 else 1 end) as presence from lineitem group by l_orderkey",
    "RST30": "select conv_id, ajoin(alistby(coalesce(text, ''), turn), ' ') as text from conversations group by conv_id",
    "RST32": "select distinct unnest(ssplit(concat_ws(' ', p_name, p_brand), ' ')) as name from part",
    "RST33": "select name, ordered(alist(distinct syn)) as synonyms from (select ssplit(p_name, ' ')[SUB0] as name, ssplit(p_name, ' ')[SUB1] as syn from part) x group by name",
    "RST36": "select c_custkey, case when c_mktsegment = 'BUILDING' then array('yeast') else ordered(aset(array(c_mktsegment, textof(c_nationkey), c_mktsegment))) end as organisms from customer",
    "RST40": "select p_partkey, fl(tr(ssplit(p_name, ' '), x -> trim(x)), x -> x <> '') as products from part",
    "RST41": "select lo, hi, seq(lo, hi) as years from (select 1990 + min(r_regionkey) as lo, 1990 + max(r_regionkey) as hi from region) x",
    "RST42": "select c_custkey, ajoin(fl(array(case when c_nationkey > 3 then concat('n=', textof(c_nationkey)) else '' end, concat('s=', lower(c_mktsegment))), x -> x <> ''), '&') as state from customer",
}
SQL = {k: v.replace("SUB", "%IDX") for k, v in SQL.items()}
