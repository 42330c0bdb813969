"""DuckDB SQL that each query is checked against: fixtures and operators written anew for a second engine; the rule vocabularies are shared."""

from __future__ import annotations

import math

from gridloom.functions import rules
from gridloom.functions.text import LENIENT_NUMBER, NON_PRINTABLE, NOT_WS, NUMERIC, WS


def gaussian() -> list[float]:
    weights = [math.exp(-((k - 2) ** 2) / (2 * 1.1**2)) for k in range(5)]
    return [w / sum(weights) for w in weights]


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


LINE_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
MONEY = "cast(cast({} as decimal(18,2)) as varchar)"

FIXTURES = {
    "f1": f"""
 select l_orderkey as doc_id, cast(l_orderkey % 7 + 1 as int) as page_number, 'lines' as method, 1 as method_rank, 1 as raw_index,
  list_concat([['Line', 'Part', 'Quantity', 'Extended Price', 'Discount', 'Shipped']], list(case when l_linenumber % 5 = 0 then [cast(l_linenumber as varchar), cast(l_partkey as varchar)]
   else [cast(l_linenumber as varchar), cast(l_partkey as varchar), {MONEY.format("l_quantity")}, {MONEY.format("l_extendedprice")},
    case when l_discount <> 0 then {MONEY.format("l_discount")} end, '  ' || strftime(l_shipdate, '%Y-%m-%d') || '  ' || l_returnflag] end order by {LINE_ORDER})) as cells
 from lineitem group by l_orderkey""",
    "f2": "select doc_id, 1 as page_number, 'text' as method, 2 as method_rank, 1 as raw_index, list_transform(list_filter(string_split(text, chr(10)), lambda x: contains(x, '|')), lambda x: string_split(x, '|')) as cells from documents where contains(text, '|')",
    "f3": "select doc_id, 1 as page_number, 'stream' as method, 3 as method_rank, 1 as raw_index, list_transform(string_split(text, chr(10)), lambda x: string_split(x, ' ')) as cells from documents where text is not null",
    "f4": """select page_id as doc_id, 1 as page_number, 'markup' as method, 4 as method_rank, 1 as raw_index,
  list_transform(list_zip(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)', 1), regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)', 2)), lambda x: [x[1], x[2]]) as cells from pages""",
    "f5": """select o_custkey as doc_id, cast(page as int) as page_number, 'lines' as method, 1 as method_rank, 1 as raw_index,
  list_concat([['Metric', 'Amount', 'Period']], list([
   case o_custkey % 9 when 0 then 'Net income Q2 ' || year(o_orderdate) when 1 then 'Total assets' when 2 then 'Free cash flow' when 3 then 'Current ratio' when 4 then 'Control sample p < 0.05 n = 12'
    when 5 then 'Phase 3 placebo' when 6 then 'Close price ACME' when 7 then 'Scope 1 emissions' else 'Sector weight' end,
   case o_custkey % 4 when 0 then '$' when 1 then 'CHF ' when 2 then 'Rs ' else '' end || format('{:,.2f}', o_totalprice), 'FY' || year(o_orderdate)] order by o_orderkey)) as cells
 from (select *, (row_number() over (partition by o_custkey order by o_orderkey, o_totalprice, o_orderdate) - 1) // 20 + 1 as page from orders) group by o_custkey, page""",
    "f6": """select vec_id as doc_id, cast(vec_id % 11 + 1 as int) as page_number, 1 as image_index, cast(8 * (1 + vec_id % 300) as int) as width, cast(8 * (1 + (vec_id * 7) % 200) as int) as height,
  list_transform(embedding, lambda v: cast(floor(abs(cast(v as double)) * 1000) as int) % 256) as pixels, cast((vec_id * 11) % 97 as int) as vector_count,
  case vec_id % 8 when 0 then 'Exhibit ' || vec_id || ' bar chart revenue 2019 axis' when 1 then 'process flow step arrow' when 2 then 'Figure ' || vec_id || ' western blot 50 nm'
   when 3 then 'table row column grid' when 4 then 'menu button window' when 5 then 'logo brand' when 6 then '' else 'line trend data 1987 and 2021' end as text from embeddings""",
    "f7": """select page_id as doc_id, 1 as page_number, block_no, cast(50 + (page_id * 7 + block_no * 13) % 90 as double) as x0, cast(60 * block_no as double) as y0,
  cast(350 + (page_id * 7 + block_no * 13) % 90 as double) as x1, cast(60 * block_no + 40 as double) as y1, case when block_no % 4 = 3 then 'Figure ' || block_no || ': ' || said else said end as text
 from (select page_id, unnest(a) as said, unnest(range(len(a))) as block_no from (select page_id, regexp_extract_all(html, '<(?:h1|p)>([^<]*)', 1) as a from pages))""",
    "boxes": "select page_id as doc_id, 1 as page_number, k as image_index, 60.0 as x0, cast(60 * (4 * k - 2) as double) as y0, 260.0 as x1, cast(60 * (4 * k - 1) - 15 as double) as y1 from pages, (select unnest([1, 2]) as k)",
    "f8": """select doc_id, format('table_p{:03d}_t001_lines_{:d}.csv', page_number, doc_id) as name,
  case when doc_id % 11 = 0 then '' when doc_id % 7 = 0 then array_to_string(list_transform(cells[1], lambda c: coalesce(c, '')), ',') || chr(10)
   else array_to_string(list_transform(cells, lambda r: array_to_string(list_transform(r, lambda c: coalesce(c, '')), ',') || case when doc_id % 5 = 0 then chr(13) || chr(10) else chr(10) end), '') end as content,
  doc_id % 13 <> 0 as on_disk from f1""",
}
NEEDS = {"f8": ["f1"]}

CLEAN_CELL = f"regexp_replace(trim(regexp_replace(coalesce(c, ''), {q(WS + '+')}, ' ', 'g'), ' '), {q(NON_PRINTABLE + '+')}, '', 'g')"
CLEANED = f"list_transform(cells, lambda r: list_transform(r, lambda c: {CLEAN_CELL}))"
FILLED = "list_filter(cells, lambda r: len(list_filter(r, lambda c: c <> '')) > 0)"
FLAT = "list_transform(flatten({0}), lambda x: x)"


def non_empty_count(cells: str) -> str:
    return f"len(list_filter(flatten({cells}), lambda c: c is not null and regexp_matches(c, {q(NOT_WS)})))"


def modal(cells: str) -> str:
    widths = f"list_transform({cells}, lambda r: len(r))"
    return f"coalesce(list_max(list_transform(list_distinct({widths}), lambda d: len(list_filter({widths}, lambda x: x = d)))), 0)"


VALID = f"len(cells) >= 2 and len(flatten(cells)) > 0 and {non_empty_count('cells')} / len(flatten(cells)) >= 0.2 and {modal('cells')} * 2 >= len(cells)"
SHOW = "array_to_string(list_transform(cells, lambda r: array_to_string(list_transform(r, lambda c: coalesce(c, '~')), '|')), chr(10))"
TEXT = "array_to_string(list_filter(flatten(cells), lambda c: c is not null and c <> ''), ' ')"
HEADER = "array_to_string(list_filter(coalesce(cells[1], []), lambda c: c is not null and c <> ''), ' ')"
IS_NUMBER = f"regexp_matches(trim(c, ' '), {q(NUMERIC)})"
WIDEST = "coalesce(list_max(list_transform(cells, lambda r: len(r))), 0)"
PADDED = f"list_transform(cells, lambda r: list_concat(r, list_transform(range({WIDEST} - len(r)), lambda i: '')))"

M_COMPLETE = f"case when len(flatten(cells)) > 0 then {non_empty_count('cells')} / len(flatten(cells)) else 0.0 end"
M_CONSISTENT = f"case when len(cells) > 0 then {modal('cells')} / len(cells) else 0.0 end"
M_STRUCTURE = f"""case when len(cells) < 2 then 0.5 else (case when len(cells[1]) > 0 then len(list_filter(cells[1], lambda c: c is not null and c <> '' and not {IS_NUMBER})) / len(cells[1]) else 0.0 end
 + case when len(cells) < 2 or len(cells[1]) < 2 then 0.3e0 when len(cells) > 1000 or len(cells[1]) > 50 then 0.7e0 else 1.0e0 end) / 2 end"""
M_SIZE = "case when len(cells) between 2 and 500 and len(coalesce(cells[1], [])) between 2 and 30 then 1.0e0 when len(cells) < 2 or len(coalesce(cells[1], [])) < 2 then 0.1e0 when len(cells) > 1000 or len(coalesce(cells[1], [])) > 50 then 0.6e0 else 0.8e0 end"
_COLUMN = "list_filter(list_transform(cells[2:], lambda r: r[k + 1]), lambda c: c is not null and c <> '')"
M_TYPES = f"""case when len(cells) < 2 then 0.5 when {WIDEST} > 0 then len(list_filter(range({WIDEST}), lambda k: len({_COLUMN}) > 0 and
 (len(list_filter({_COLUMN}, lambda c: {IS_NUMBER})) > len({_COLUMN}) * 0.8e0 or len(list_filter({_COLUMN}, lambda c: {IS_NUMBER})) < len({_COLUMN}) * 0.2e0))) / {WIDEST} else 0.0 end"""
#: Over a relation ``c`` of cleaned grids.
SCORED = f"""metrics as (select *, cast({M_COMPLETE} as double) as completeness, cast({M_CONSISTENT} as double) as consistency, cast({M_STRUCTURE} as double) as structure, cast({M_TYPES} as double) as data_types, {M_SIZE} as size_appropriateness from c),
scored as (select *, case when len(cells) >= 2 then completeness * 0.3e0 + consistency * 0.2e0 + structure * 0.2e0 + data_types * 0.2e0 + size_appropriateness * 0.1e0 else 0.0e0 end as quality_score from metrics)"""


def _sum(terms: list[str]) -> str:
    return " + ".join(terms)


def _points(test: str, n: float) -> str:
    return f"case when {test} then {n} else 0 end"


def table_score(kind: str) -> str:
    words, patterns = rules.TABLE_TYPES[kind]
    terms = [f"{_points(f'contains(table_text, {q(w)})', 2)} + {_points(f'contains(header_text, {q(w)})', 3)}" for w in words]
    return _sum(terms + [f"len(regexp_extract_all(table_text, {q(p)})) * 2" for p in patterns])


def first_best(types, prefix: str, none: str) -> str:
    top = f"greatest({', '.join(prefix + k for k in types)})"
    return f"case when {top} = 0 then {q(none)} {' '.join(f'when {prefix}{k} = {top} then {q(k)}' for k in types)} end"


TYPED = f"""texts as (select *, lower({TEXT}) as table_text, lower({HEADER}) as header_text, {TEXT} as plain_text from scored),
points as (select *, {", ".join(f"{table_score(k)} as s_{k}" for k in rules.TABLE_TYPES)} from texts),
typed as (select *, {first_best(rules.TABLE_TYPES, "s_", rules.GENERAL_TABLE)} as table_type from points)"""

CURRENCY = f"case {' '.join(f'when contains(plain_text, {q(a)}) then {q(b)}' for a, b in rules.CURRENCIES)} end"
_unit = lambda u: f"case when regexp_matches(plain_text, {q(rf'(?i)\b{u}\b')}) then {q(u)} end"
UNITS = f"array_to_string(list_filter([{', '.join(_unit(u) for u in rules.UNITS)}], lambda x: x is not null), ',')"
PERIOD = f"coalesce({', '.join(f'nullif(regexp_extract(plain_text, {q(p)}, 0), {q("")})' for p in rules.PERIODS)})"
TICKERS = f"array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(plain_text, {q(rules.TICKER)}), lambda x: x not in ({', '.join(map(q, rules.NO_TICKERS))}))))[1:10], ',')"


def _in(types: list[str]) -> str:
    return f"table_type in ({', '.join(map(q, types))})"


def with_(body: str, *names: str) -> str:
    """``body`` after the fixtures that it names and theirs; ``body`` may begin with more common table expressions and a last select."""
    order: list[str] = []
    for n in names:
        order += [x for x in [*NEEDS.get(n, []), n] if x not in order]
    return "with recursive " + ",\n".join(f"{n} as ({FIXTURES[n]})" for n in order) + body


def cleaned(source: str, where: str | None = None) -> str:
    """Common table expressions up to ``c``, the cleaned grids of ``source``."""
    return f",\nraw as (select * from {source}{f' where {where}' if where else ''}),\nwhite as (select * exclude (cells), {CLEANED} as cells from raw),\nc as (select * exclude (cells), {FILLED} as cells from white)"


METHODS = """both_methods as (select * from f1 union all select doc_id, page_number, 'stream', 3, 1, cells from f1 where doc_id % 3 = 0)"""
CATALOG = f"""numbered as (select *, row_number() over (partition by doc_id, page_number order by method_rank, raw_index) as table_index from typed),
nth as (select *, row_number() over (partition by doc_id, page_number, cells order by table_index) as n from numbered),
kept as (select * from nth where n = 1 and len(cells) > 0),
body as (select *, {PADDED} as padded from kept),
catalog as (select doc_id, page_number, cast(table_index as int) as table_index, method, table_type, quality_score, len(cells) as rows, {WIDEST} as columns,
  case when len(flatten(padded[2:])) > 0 then len(list_filter(flatten(padded[2:]), lambda c: regexp_matches(c, {q(LENIENT_NUMBER)}) and (contains(lower(c), 'inf') or abs(try_cast(trim(c) as double)) < 'infinity'::double))) / len(flatten(padded[2:])) else 0.0 end as numeric_percentage,
  case when len(flatten(padded[2:])) > 0 then len(list_filter(flatten(padded[2:]), lambda c: c = '')) / len(flatten(padded[2:])) else 1.0 end as empty_cell_percentage,
  format('table_p{{:03d}}_t{{:03d}}_{{}}.csv', page_number, table_index, method) as filename,
  list_sum(list_transform(padded, lambda r: strlen(array_to_string(r, ',')) + 1)) as size_bytes from body)"""
#: The catalog of the order grids, a third of them found by a second method as well.
CATALOGED = f",\n{METHODS}" + cleaned("both_methods", VALID) + f",\n{SCORED},\n{TYPED},\n{CATALOG}\n"

_NEAR = "boxes i left join f7 b on i.doc_id = b.doc_id and i.page_number = b.page_number"
_BELOW = "coalesce(b.y0 > i.y1 and b.y0 - i.y1 < 50 and abs(b.x0 - i.x0) < 100, false)"
_TEXT_OF_PAGE = "page_texts as (select doc_id, page_number, string_agg(text, chr(10) order by block_no) as text from f7 group by all)"

N64 = "len(pixels)"
MEAN = f"cast(list_sum(pixels) as double) / {N64}"
VAR = "cast({n} * list_sum(list_transform({a}, lambda x: cast(x as bigint) * x)) - list_sum({a}) * list_sum({a}) as double) / ({n} * {n})"
CONTRAST = f"least(sqrt({VAR.format(a='pixels', n=N64)}) / 127.5, 1.0)"
BRIGHTNESS = f"1 - abs({MEAN} - 127.5) / 127.5"
_B = lambda e: f"(case when {e} < 0 then -({e}) when {e} > 7 then 14 - ({e}) else {e} end)"
_at = lambda r, c: f"pixels[{_B(r)} * 8 + {_B(c)} + 1]"
_R, _C = "(i // 8)", "(i % 8)"
LAPLACIAN = f"list_transform(range(64), lambda i: {_at(_R + ' - 1', _C)} + {_at(_R + ' + 1', _C)} + {_at(_R, _C + ' - 1')} + {_at(_R, _C + ' + 1')} - 4 * pixels[i + 1])"
RESOLUTION = "case when cast(width as bigint) * height >= 2073600 then 1.0 when cast(width as bigint) * height >= 921600 then 0.8 when cast(width as bigint) * height >= 307200 then 0.6 when cast(width as bigint) * height >= 76800 then 0.4 else 0.2 end"
_SPAN = "(case when {0} < 0 then 0 when {0} > 7 then 7 else {0} end)"
_px = lambda r, c: f"pixels[{_SPAN.format(f'(i // 8 + {r})')} * 8 + {_SPAN.format(f'(i % 8 + {c})')} + 1]"
_mag = lambda r, c: f"case when i // 8 + {r} between 0 and 7 and i % 8 + {c} between 0 and 7 then ms[i + {8 * r + c} + 1] else 0 end"
#: Canny's edges of the 8 by 8 images: Sobel gradients, thinned along their direction, above 50 and connected to one above 150.
EDGES = f""",
gradients as (select doc_id, i, {_px(-1, 1)} + 2 * {_px(0, 1)} + {_px(1, 1)} - {_px(-1, -1)} - 2 * {_px(0, -1)} - {_px(1, -1)} as gx,
  {_px(1, -1)} + 2 * {_px(1, 0)} + {_px(1, 1)} - {_px(-1, -1)} - 2 * {_px(-1, 0)} - {_px(-1, 1)} as gy from (select doc_id, pixels, unnest(range(64)) as i from f6)),
sizes as (select doc_id, list(abs(gx) + abs(gy) order by i) as ms from gradients group by doc_id),
sided as (select g.doc_id, i, ms[i + 1] as m, abs(gy) < 0.41421356237309503e0 * abs(gx) as flat, abs(gy) > 2.414213562373095e0 * abs(gx) as steep, (gx < 0) <> (gy < 0) as rising, ms from gradients g join sizes using (doc_id)),
thin as (select doc_id, i // 8 as r, i % 8 as c, m from sided where m > 50
  and m > case when flat then {_mag(0, -1)} when steep then {_mag(-1, 0)} when rising then {_mag(-1, 1)} else {_mag(-1, -1)} end
  and case when flat then m >= {_mag(0, 1)} when steep then m >= {_mag(1, 0)} when rising then m > {_mag(1, -1)} else m > {_mag(1, 1)} end),
edges as (select doc_id, r, c from thin where m > 150 union select t.doc_id, t.r, t.c from edges e join thin t on t.doc_id = e.doc_id and abs(t.r - e.r) <= 1 and abs(t.c - e.c) <= 1),
edged as (select f6.*, coalesce(n, 0) / 64 as edge_density from f6 left join (select doc_id, count(*) as n from edges group by 1) using (doc_id))"""
_WEIGHTS = "[{}]".format(", ".join(repr(float(a * b)) + "e0" for a in gaussian() for b in gaussian()))
SMOOTHED = f"list_sum(list_transform(range(25), lambda k: {_WEIGHTS}[k + 1] * {_at('(i // 8 + k // 5 - 2)', '(i % 8 + k % 5 - 2)')}))"
NOISE = f"greatest(1 - list_sum(list_transform(range(64), lambda i: abs(pixels[i + 1] - {SMOOTHED}))) / 64 / 50, 0)"
SHARPNESS = f"least({VAR.format(a='lap', n='len(lap)')} / 1000, 1.0)"
QUALITY = f"{RESOLUTION} * 0.3e0 + {SHARPNESS} * 0.2e0 + {CONTRAST} * 0.2e0 + ({BRIGHTNESS}) * 0.2e0 + {NOISE} * 0.1e0"
CUT = "cast(floor(least(greatest({}, 0e0), 255e0)) as int)"
CONTRASTED = f"list_transform(pixels, lambda p: {CUT.format(f'floor({MEAN} + 0.5) + 1.5e0 * (p - floor({MEAN} + 0.5))')})"
_INNER = "floor((4 * {a}[i + 1] + {around}) / 13e0 + 0.5)"


def sharpened(a: str, factor: str) -> str:
    """``a`` sharpened against its smoothed inside."""
    around = " + ".join(f"{a}[i + {8 * r + c} + 1]" for r in (-1, 0, 1) for c in (-1, 0, 1))
    smooth = f"case when i // 8 between 1 and 6 and i % 8 between 1 and 6 then {_INNER.format(a=a, around=around)} else {a}[i + 1] end"
    return f"list_transform(range(64), lambda i: {CUT.format(f'({smooth}) + {factor} * ({a}[i + 1] - ({smooth}))')})"


ASPECT = "case when height > 0 then width / height else 0 end"


def image_score(kind: str, vectors: str) -> str:
    words, edges, aspect, vector = rules.IMAGE_TYPES[kind]
    terms = [_points(f"contains(lower(text), {q(w)})", 2) for w in words]
    terms += [_points(f"edge_density between {edges[0]}e0 and {edges[1]}e0", 1), _points(f"{ASPECT} between {aspect[0]} and {aspect[1]}", 0.5)]
    return _sum(terms + ([_points(f"{vectors} > 50", 3)] if vector else []))


def image_typed(vectors: str = "vector_count", name: str = "image_typed") -> str:
    return f",\n{name}_points as (select *, {', '.join(f'{image_score(k, vectors)} as s_{k}' for k in rules.IMAGE_TYPES)} from edged),\n{name} as (select *, {first_best(rules.IMAGE_TYPES, 's_', rules.GENERAL_IMAGE)} as image_type from {name}_points)\n"


IMAGE_TYPED = EDGES + image_typed()


def choose(choices, none: str) -> str:
    return f"case {' '.join('when ' + ' or '.join(f'contains(lower(text), {q(w)})' for w in words) + f' then {q(name)}' for name, words in choices)} else {q(none)} end"


def _issue(test: str, issue: str, severity: str, detail: str = "cast(null as varchar)") -> str:
    return f"select doc_id, name, {q(issue)} as issue, {q(severity)} as severity, {detail} as detail from facts where {test}"


_FACTS = """facts as (select *, len(string_split(content, chr(10))) - 1 as feeds, len(string_split(content, chr(13) || chr(10))) - 1 as returns, len(string_split(regexp_extract(content, '^[^\\r\\n]*', 0), ',')) as width,
  len(list_filter(string_split(content, chr(10)), lambda x: replace(x, chr(13), '') <> '')) as filled_lines from f8 where on_disk)"""
_CHECKS = " union all ".join([
    _issue("content = ''", "empty_file", "critical"), _issue("content <> '' and filled_lines < 2", "no_data", "warning"), _issue("content <> '' and width > 100", "too_many_columns", "warning", "cast(width as varchar)"),
    _issue("content <> '' and returns > 0", "mixed_line_endings", "minor", "(feeds - returns) || '/' || returns"), _issue("content <> '' and feeds <= 1", "single_line_file", "critical")])
ISSUES = f",\n{_FACTS},\nissues as ({_CHECKS})\n"
_EVERY_ISSUE = ISSUES + ", every_issue as (select name, issue, severity from issues union all select name, 'file_missing', 'critical' from f8 where not on_disk)\n"

_PACK = "name, len(lines) as n_rows, case when len(lines) > 0 then len(string_split(lines[1], ',')) else 0 end as n_columns, strlen(content) as size_bytes, md5(content) as content_md5"
_LINES = "(select *, list_filter(string_split(replace(content, chr(13), ''), chr(10)), lambda x: x <> '') as lines from f8 where on_disk)"

GRID_KEY = "doc_id, page_number, method"

ORACLES = {
    "src_order_grid": with_(f" select {GRID_KEY}, {SHOW} as grid from f1", "f1"),
    "src_pipe_grid": with_(f" select {GRID_KEY}, {SHOW} as grid from f2", "f2"),
    "src_line_grid": with_(f" select {GRID_KEY}, md5({SHOW}) as grid_md5 from f3", "f3"),
    "src_nav_grid": with_(f" select {GRID_KEY}, {SHOW} as grid from f4", "f4"),
    "method_union": with_(", all_grids as (select * from f1 union all select * from f2 union all select * from f3 union all select * from f4)"
                          " select method, count(*) as n_grids, sum(len(cells)) as n_rows, sum(len(flatten(cells))) as n_cells from all_grids group by method", "f1", "f2", "f3", "f4"),
    "clean_cells": with_(f", w as (select {GRID_KEY}, {CLEANED} as cells from f1) select {GRID_KEY}, {SHOW} as grid from w", "f1"),
    "drop_empty_rows": with_(cleaned("f3") + f" select {GRID_KEY}, len(cells) as n_rows, md5({SHOW}) as grid_md5 from c", "f3"),
    "pad_rows": with_(cleaned("f1") + f", p as (select {GRID_KEY}, {PADDED} as cells from c) select {GRID_KEY}, {SHOW} as grid from p", "f1"),
    "promote_header": with_(cleaned("f1") + f", p as (select {GRID_KEY}, array_to_string(cells[1], '|') as header, cells[2:] as cells from c) select {GRID_KEY}, header, {SHOW} as grid from p", "f1"),
    "table_text": with_(cleaned("f5") + f" select {GRID_KEY}, lower({TEXT}) as table_text, lower({HEADER}) as header_text from c", "f5"),
    "valid_grid": with_(f" select doc_id, method, len(cells) as n_rows from f3 where {VALID} union all select doc_id, method, len(cells) from f2 where {VALID}", "f2", "f3"),
    "page_slice": with_(" select doc_id, page_number, len(cells) as n_rows from f1 where page_number between 2 and 5", "f1"),
    "q_completeness": with_(cleaned("f1") + f" select doc_id, round(cast({M_COMPLETE} as double), 6) as completeness from c", "f1"),
    "q_consistency": with_(cleaned("f3") + f" select doc_id, round(cast({M_CONSISTENT} as double), 6) as consistency from c", "f3"),
    "q_structure": with_(cleaned("f1") + f" select doc_id, round(cast({M_STRUCTURE} as double), 6) as structure from c", "f1"),
    "q_data_types": with_(cleaned("f1") + f" select doc_id, round(cast({M_TYPES} as double), 6) as data_types from c", "f1"),
    "q_size": with_(cleaned("f3") + f" select doc_id, {M_SIZE} as size_appropriateness from c", "f3"),
    "table_quality": with_(cleaned("f5", VALID) + f", {SCORED} select doc_id, round(quality_score, 6) as quality_score from scored", "f5"),
    "quality_filter": with_(cleaned("f1", VALID) + f", {SCORED} select doc_id, round(quality_score, 6) as quality_score from scored where quality_score >= 0.85", "f1"),
    "quality_band": with_(cleaned("f1") + f", {SCORED} select case when quality_score >= 0.7 then 'high' when quality_score >= 0.4 then 'medium' else 'low' end as band, count(*) as n from scored group by 1", "f1"),
    "class_scores": with_(cleaned("f5") + f", {SCORED},\n{TYPED} select doc_id, {', '.join(f'cast(s_{k} as int) as {k}' for k in rules.TABLE_TYPES)} from typed", "f5"),
    "classify_table": with_(cleaned("f5") + f", {SCORED},\n{TYPED} select doc_id, table_type from typed", "f5"),
    "table_facets": with_(cleaned("f5") + f""", {SCORED},\n{TYPED} select doc_id, table_type, case when {_in(rules.CURRENCY_TYPES)} then {CURRENCY} end as currency, case when {_in(rules.UNIT_TYPES)} then {UNITS} end as units,
      case when {_in(rules.PERIOD_TYPES)} then {PERIOD} end as fiscal_period, case when {_in(rules.TICKER_TYPES)} then {TICKERS} end as tickers from typed""", "f5"),
    "facet_currency": with_(cleaned("f5") + f", {SCORED},\n{TYPED} select doc_id, {CURRENCY} as currency from typed", "f5"),
    "facet_units": with_(cleaned("f5") + f", {SCORED},\n{TYPED} select doc_id, {UNITS} as units from typed", "f5"),
    "facet_fiscal": with_(cleaned("f5") + f", {SCORED},\n{TYPED} select doc_id, {PERIOD} as fiscal_period from typed", "f5"),
    "facet_tickers": with_(cleaned("f5") + f", {SCORED},\n{TYPED} select doc_id, {TICKERS} as tickers from typed", "f5"),
    "facet_stats": with_(cleaned("f5") + f", {SCORED},\n{TYPED} select doc_id, regexp_matches(plain_text, 'p\\s*[<=]\\s*0\\.[0-9]+') as has_p_values, regexp_matches(plain_text, '(?i)(CI|confidence\\s*interval)') as has_confidence_intervals from typed", "f5"),
    "numeric_pct": with_(CATALOGED + " select doc_id, table_index, round(numeric_percentage, 6) as numeric_percentage from catalog", "f1"),
    "empty_pct": with_(CATALOGED + " select doc_id, table_index, round(empty_cell_percentage, 6) as empty_cell_percentage from catalog", "f1"),
    "table_index": with_(f", {METHODS} select doc_id, page_number, method, cast(row_number() over (partition by doc_id, page_number order by method_rank, raw_index) as int) as table_index from both_methods", "f1"),
    "dedup_grids": with_(CATALOGED + " select doc_id, page_number, table_index, method from catalog", "f1"),
    "table_filename": with_(CATALOGED + " select doc_id, filename from catalog", "f1"),
    "table_catalog": with_(CATALOGED + " select doc_id, page_number, table_index, method, table_type, round(quality_score, 6) as quality_score, rows, columns, true as has_headers, round(numeric_percentage, 6) as numeric_percentage, round(empty_cell_percentage, 6) as empty_cell_percentage, filename, size_bytes from catalog", "f1"),
    "type_histogram": with_(CATALOGED + " select table_type, count(*) as n, round(avg(quality_score), 6) as avg_quality from catalog group by 1", "f1"),
    "quality_histogram": with_(CATALOGED + " select case when quality_score >= 0.7 then 'high' when quality_score >= 0.4 then 'medium' else 'low' end as band, count(*) as n from catalog group by 1", "f1"),
    "method_histogram": with_(f", {METHODS} select method, count(*) as n from both_methods where {VALID} group by 1", "f1"),
    "doc_stats": with_(CATALOGED + " select doc_id, count(*) as n_tables, count(distinct page_number) as n_pages, round(avg(quality_score), 6) as avg_quality from catalog group by 1", "f1"),
    "topk_tables": with_(CATALOGED + " select doc_id, page_number, table_index, size_bytes from catalog order by size_bytes desc, doc_id, page_number, table_index limit 10", "f1"),
    "limit_items": with_(CATALOGED + " select doc_id, table_index, filename from catalog order by doc_id, page_number, table_index limit 25", "f1"),
    "verify_files": with_(ISSUES + "select * from issues", "f8"),
    "verify_missing": with_(" select name, 'file_missing' as issue, 'critical' as severity from f8 where not on_disk", "f8"),
    "verify_summary": with_(ISSUES + "select severity, issue, count(*) as n from issues group by all union all select 'critical', 'file_missing', count(*) from f8 where not on_disk", "f8"),
    "package_tables": with_(f" select {_PACK} from {_LINES}", "f8"),
    "package_semi_join": with_(" select name from f8 where on_disk", "f8"),
    "base64_fallback": with_(" select name, case when doc_id % 2 = 1 then to_base64(encode(content)) end as content_base64 from f8 where on_disk", "f8"),
    "public_url": with_(" select name, 'https://store.example/storage/v1/object/public/files/' || '202401' || lpad(cast(doc_id % 28 + 1 as varchar), 2, '0') || '_093005_' || name as url from f8 where on_disk", "f8"),
    "envelope": with_(CATALOGED + ", n as (select (select count(*) from catalog) as t, (select count(*) from embeddings) as i) select t + i as count, t as tables_count, i as images_count, true as success from n", "f1"),
    "blocks_scan": with_(" select doc_id, page_number, block_no, x0, y0, x1, y1, text from f7", "f7"),
    "caption_join": with_(f""", hits as (select i.doc_id, i.page_number, i.image_index, max_by(trim(b.text, ' '), b.block_no) filter ({_BELOW} and regexp_matches(trim(b.text, ' '), {q(rules.CAPTION)})) as caption from {_NEAR} group by all)
      select *, nullif(regexp_extract(caption, {q(rules.REFERENCE)}, 0), '') as figure_reference from hits""", "f7", "boxes"),
    "surrounding_text": with_(f" select i.doc_id, i.page_number, i.image_index, coalesce(string_agg(trim(b.text, ' '), '|' order by b.block_no) filter (not {_BELOW} and (abs(b.y0 - i.y0) < 100 or abs(b.y1 - i.y1) < 100)), '') as surrounding_text from {_NEAR} group by all", "f7", "boxes"),
    "page_title": with_(" select doc_id, page_number, min_by(trim(text, ' '), block_no) filter (length(trim(text, ' ')) between 11 and 99) as page_title from f7 where block_no < 3 group by all", "f7"),
    "page_preview": with_(f", {_TEXT_OF_PAGE} select doc_id, page_number, case when length(text) > 200 then substring(text, 1, 200) || '...' else text end as page_text_preview from page_texts", "f7"),
    "exhibits": with_(" select doc_id, page_number, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '(?i)Exhibit\\s*[0-9]+'))), ',') as exhibits_mentioned from f6", "f6"),
    "img_geometry": with_(f" select doc_id, width, height, round({ASPECT}, 6) as aspect_ratio from f6", "f6"),
    "img_size_filter": with_(" select doc_id, width, height from f6 where width >= 100 and height >= 100", "f6"),
    "vector_page_filter": with_(" select doc_id, page_number, vector_count from f6 where vector_count >= 10", "f6"),
    "image_union": with_(" select doc_id, 'embedded' as method, image_index, cast(null as varchar) as vector_count from f6 where width >= 100 and height >= 100 union all select doc_id, 'vector_render', 1, cast(vector_count as varchar) from f6 where vector_count >= 10", "f6"),
    "image_filename": with_(IMAGE_TYPED + "select doc_id, case when vector_count >= 10 then 'page_' || page_number || '_vector_' || image_type || '.png' else 'page_' || page_number || '_img_' || image_index || '_' || image_type || '.png' end as filename from image_typed", "f6"),
    "ocr_coalesce": with_(" select doc_id, case when doc_id % 2 = 0 and trim(text, ' ') <> '' then trim(text, ' ') when doc_id % 3 = 0 then 'second' else '' end as ocr_text from f6", "f6"),
    "img_resolution": with_(f" select doc_id, cast({RESOLUTION} as double) as resolution from f6", "f6"),
    "img_contrast": with_(f" select doc_id, round({CONTRAST}, 6) as contrast from f6", "f6"),
    "img_brightness": with_(f" select doc_id, round({BRIGHTNESS}, 6) as brightness from f6", "f6"),
    "img_sharpness": with_(f", l as (select doc_id, {LAPLACIAN} as lap from f6) select doc_id, round({SHARPNESS}, 6) as sharpness from l", "f6"),
    "classify_image": with_(IMAGE_TYPED + "select doc_id, image_type from image_typed", "f6"),
    "facet_chart": with_(IMAGE_TYPED + f"select doc_id, {choose(rules.CHARTS, 'unknown')} as chart_type, nullif(regexp_extract(lower(text), 'exhibit\\s*([0-9]+)', 1), '') as exhibit_number, array_to_string(regexp_extract_all(text, '\\b(19|20)[0-9]{{2}}\\b', 1), ',') as years_referenced from image_typed where image_type = 'chart'", "f6"),
    "facet_diagram": with_(IMAGE_TYPED + f"select doc_id, {choose(rules.DIAGRAMS, 'general_diagram')} as diagram_type from image_typed where image_type = 'diagram'", "f6"),
    "facet_scientific": with_(IMAGE_TYPED + f"select doc_id, {choose(rules.FIGURES, 'general_scientific')} as figure_type, nullif(regexp_extract(text, {q(rules.SCALE)}, 0), '') as scale from image_typed where image_type = 'scientific_figure'", "f6"),
    "csv_roundtrip": with_(cleaned("f1") + " select doc_id, len(cells) as n_rows, true as same from c", "f1"),
    "img_scan": with_(""" select doc_id, len(pixels) as n_pixels, array_to_string(pixels, ',') as gray,
      array_to_string(list_transform(pixels, lambda p: ((p // 2) * 19595 + (255 - p) * 38470 + p * 7471 + 32768) // 65536), ',') as mixed from f6""", "f6"),
    "img_color": with_(""", wide as (select doc_id, pixels, list_concat(list_concat(pixels, list_transform(pixels, lambda p: 255 - p)), list_transform(pixels, lambda p: p // 2)) as bytes from f6)
      select doc_id, round(list_var_pop(bytes), 6) as color_variance, round(list_avg(list_transform(pixels, lambda p: p // 2)), 6) as mean_red,
      round(list_avg(list_transform(pixels, lambda p: 255 - p)), 6) as mean_green, round(list_avg(pixels), 6) as mean_blue from wide""", "f6"),
    "image_index": with_(""" select doc_id // 20 as doc_id, page_number, row_number() over (partition by doc_id // 20, page_number order by doc_id) as image_index, doc_id as vec_id, width, height from f6""", "f6"),
    "img_edge_density": with_(EDGES + " select doc_id, round(edge_density, 6) as edge_density from edged", "f6"),
    "img_segments": with_(EDGES + """, islands as (select doc_id, r as line, c as k, 'row' as side from edges union all select doc_id, c, r, 'column' from edges),
      starts as (select *, case when k - lag(k) over w <= 2 then 0 else 1 end as fresh from islands window w as (partition by doc_id, side, line order by k)),
      groups as (select *, sum(fresh) over (partition by doc_id, side, line order by k) as part from starts),
      runs as (select doc_id, side from groups group by doc_id, side, line, part having max(k) - min(k) >= 5)
      select f6.doc_id, count(*) filter (side = 'row') as estimated_rows, count(*) filter (side = 'column') as estimated_columns from f6 left join runs using (doc_id) group by 1""", "f6"),
    "img_noise": with_(f" select doc_id, round({NOISE}, 6) as noise from f6", "f6"),
    "img_quality": with_(f", l as (select *, {LAPLACIAN} as lap from f6) select doc_id, round({QUALITY}, 6) as quality_score from l", "f6"),
    "img_quality_filter": with_(f", l as (select *, {LAPLACIAN} as lap from f6), scored as (select doc_id, {QUALITY} as quality_score from l) select doc_id, round(quality_score, 6) as quality_score from scored where quality_score >= 0.5", "f6"),
    "enhance_line_art": with_(f", e as (select doc_id, {CONTRASTED} as px from f6) select doc_id, array_to_string({sharpened('px', '2e0')}, ',') as pixels from e", "f6"),
    "enhance_screenshot": with_(f" select doc_id, array_to_string({sharpened('pixels', '1.3e0')}, ',') as pixels from f6", "f6"),
    "enhance_by_type": with_(IMAGE_TYPED + f""", e as (select doc_id, image_type, pixels, {CONTRASTED} as px from image_typed) select doc_id, image_type,
      array_to_string(case when image_type in ('chart', 'diagram', 'table_image') then {sharpened('px', '2e0')} when image_type = 'screenshot' then {sharpened('pixels', '1.3e0')}
      when image_type = 'photograph' then list_transform(pixels, lambda p: case when {MEAN} < 100 then least(255, cast(floor(p * 1.2e0) as int)) when {MEAN} > 155 then cast(floor(p * 0.8e0) as int) else p end) else pixels end, ',') as pixels from e""", "f6"),
    "extract_images": with_(IMAGE_TYPED + f"""{image_typed("0", "plain_typed")}, l as (select *, {LAPLACIAN} as lap from plain_typed where page_number <= 9 and width >= 100 and height >= 100),
      both_kinds as (select doc_id, page_number, image_index, 'embedded' as method, image_type from l where {QUALITY} >= 0.3
       union all select doc_id, page_number, 1, 'vector_render', image_type from image_typed where page_number <= 9 and vector_count >= 10),
      found as (select * from both_kinds order by 1, 2, 3, 4 limit 200)
      select doc_id, page_number, method, image_type, case when method = 'vector_render' then 'page_' || page_number || '_vector_' || image_type || '.png' else 'page_' || page_number || '_img_' || image_index || '_' || image_type || '.png' end as filename from found""", "f6"),
    "extract_all": with_(" select count(*) filter (width >= 100 and height >= 100) as embedded_images, count(*) filter (vector_count >= 10) as vector_images, count(distinct page_number) as pages_with_images,"
                         " count(distinct case when vector_count >= 10 then page_number end) as pages_with_vectors from f6 where page_number <= 9", "f6"),
    "extract_tables": with_(CATALOGED.replace("from both_methods where ", "from both_methods where page_number between 2 and 6 and ", 1) + " select doc_id, page_number, table_index, filename from catalog order by doc_id, page_number, table_index limit 1000", "f1"),
    "enforced_catalog": with_(CATALOGED.replace("from scored)", "from scored where quality_score >= 0.85)", 1) + " select doc_id, page_number, table_index, method, table_type, round(quality_score, 6) as quality_score from catalog", "f1"),
    "ranked_types": with_(CATALOGED + ", h as (select table_type, count(*) as n, round(avg(quality_score), 6) as avg_quality from catalog group by 1) select *, row_number() over (order by n desc, table_type) as place from h", "f1"),
    "ranked_methods": with_(f", {METHODS}, h as (select method, count(*) as n from both_methods where {VALID} group by 1) select *, row_number() over (order by n desc, method) as place from h", "f1"),
    "filtered_count": with_(cleaned("f1", VALID) + f", {SCORED} select count(*) filter (quality_score >= 0.85) as kept, count(*) filter (not quality_score >= 0.85) as filtered from scored", "f1"),
    "throughput": with_(" select round(count(*) / 60e0, 6) as pages_per_second from (select distinct doc_id, page_number from f1)", "f1"),
    "first_critical": with_(_EVERY_ISSUE + "select * from (select * from every_issue order by name, issue limit 5) where severity = 'critical'", "f8"),
    "verify_unparseable": with_(ISSUES + "select * from issues where doc_id % 4 = 3 and issue <> 'empty_file' union all select doc_id, name, case when doc_id % 4 = 0 then 'pandas_empty_data' else 'read_error' end, 'critical', null from f8 where on_disk and content <> '' and doc_id % 4 <> 3", "f8"),
    "csv_export": with_(cleaned("f1") + """, p as (select doc_id, """ + PADDED + """ as cells from c),
      lines as (select doc_id, list_transform(cells, lambda r: array_to_string(list_transform(r, lambda x: case when contains(x, '.') then '"' || replace(x, '.', ',""') || '"' else x end), ',') || chr(10)) as lines from p)
      select cast(doc_id as varchar) as name, strlen(array_to_string(lines, '')) as size_bytes, md5(array_to_string(lines, '')) as content_md5 from lines""", "f1"),
    "metadata_doc": with_(CATALOGED + """ select doc_id, '{"doc_id":' || doc_id || ',"tables_extracted":' || count(*) || ',"tables":[' || string_agg('{"page_number":' || page_number || ',"table_index":' || table_index || ',"table_type":"' || table_type
      || '","quality_score":' || round(quality_score, 6) || ',"filename":"' || filename || '"}', ',' order by page_number, table_index) || ']}' as document from catalog group by doc_id""", "f1"),
    "img_gridlines": with_(" select doc_id, len(list_filter(range(8), lambda r: list_max(list_transform(range(8), lambda c: pixels[r * 8 + c + 1])) < 200)) as estimated_rows,"
                           " len(list_filter(range(8), lambda c: list_max(list_transform(range(8), lambda r: pixels[r * 8 + c + 1])) < 200)) as estimated_columns from f6", "f6"),
    "image_stats": with_(" select count(*) filter (width >= 100 and height >= 100) as embedded_images, count(*) filter (vector_count >= 10) as vector_images, count(distinct page_number) as pages_with_images, count(distinct case when vector_count >= 10 then page_number end) as pages_with_vectors from f6", "f6"),
    "ocr_rate": with_(" select round(coalesce(avg(case when trim(text, ' ') <> '' then 1.0 else 0.0 end), 0), 6) as ocr_rate from f6", "f6"),
    "enhance_brightness": with_(f" select doc_id, array_to_string(list_transform(pixels, lambda p: case when {MEAN} < 100 then least(255, cast(floor(p * 1.2e0) as int)) when {MEAN} > 155 then least(255, cast(floor(p * 0.8e0) as int)) else p end), ',') as pixels from f6", "f6"),
    "verify_images": with_(" select doc_id, width, height, 'too_small' as issue, 'warning' as severity from f6 where width < 10 or height < 10", "f6"),
    "package_images": with_(IMAGE_TYPED + "select doc_id, page_number as page, image_index as index, image_type, width, height, text <> '' as has_text, text as text_content, vector_count, true as enhancement_applied, row_number() over (order by doc_id) <= 50 as within_limit from image_typed", "f6"),
}
