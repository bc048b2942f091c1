"""SQL of the attribute records, terms and channels, for comparing the operators with another engine.

The text steps are written anew in SQL from the same domain pack. NFKC, which SQL lacks, is a translation of all characters whose
folded form is one character (made by rule from the Unicode database), a few longer ones, and composition.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

from samewise.config import DEFAULT_PACK, DEFAULTS, DomainPack
from samewise.functions import extract as X
from samewise.functions import text as T

FIRST = "(select * from listings where sku_id is not null qualify row_number() over (partition by sku_id order by row_ord) = 1)"
PLAIN = "'[^\\x00-\\x7f\\x{4e00}-\\x{9fff}\\x{c0}-\\x{17e}。、]'"
#: Characters that fold to several ones: signs of product texts, and the block of squared words and units.
LONGER = "…½¼¾⅓⅔⅛™℃" + "".join(c for c in map(chr, range(0x3300, 0x3400)) if len(unicodedata.normalize("NFKC", c)) > 1)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@functools.cache
def _folds() -> tuple[str, str]:
    source, target = [], []
    for c in map(chr, range(0x80, sys.maxunicode + 1)):
        if unicodedata.category(c) in ("Cs", "Cn"):
            continue
        to = T.plain_sign(f) if len(f := unicodedata.normalize("NFKC", c)) == 1 and ord(f) > 127 else f
        if len(to) == 1 and to != c and unicodedata.normalize("NFC", c) == c:
            source.append(c)
            target.append(to)
    return "".join(source), "".join(target)


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def nfkc(x: str) -> str:
    out = f"coalesce({x}, '')"
    for c in LONGER:
        out = f"replace({out}, {quoted(c)}, {quoted(unicodedata.normalize('NFKC', c))})"
    source, target = _folds()
    # most texts hold nothing to translate: ASCII, ideographs, accented Latin letters and two marks fold to themselves
    return squeeze(f"nfc_normalize(case when regexp_matches({x}, {PLAIN}) then translate({out}, {quoted(source)}, {quoted(target)}) else coalesce({x}, '') end)")


def without(x: str, pattern: str) -> str:
    return squeeze(f"regexp_replace({x}, {quoted(f'(?:{pattern})')}, ' ', 'gi')")


def clean(x: str, pack: DomainPack = DEFAULT_PACK) -> str:
    return squeeze(f"regexp_replace({without(without(x, pack.gift), pack.noise)}, '[\\[(【（]\\s*[\\])】）]', ' ', 'g')")


def packfree(x: str, pack: DomainPack = DEFAULT_PACK) -> str:
    no_units = f"regexp_replace({clean(x, pack)}, {quoted(rf'\d+(?:\.\d+)?\s*(?:{T.unit_pattern(pack)})')}, ' ', 'gi')"
    return without(no_units, T.PACK_WORDS)


def fold(x: str) -> str:
    return f"regexp_replace(lower(coalesce({x}, '')), '[^\\p{{L}}\\p{{N}}_%]+', '', 'g')"


def numbers_apart(x: str) -> str:
    out = f"coalesce({x}, '')"
    for pattern, put in X.NUMBER_STEPS:
        out = f"regexp_replace({out}, {quoted(pattern.removeprefix('(?i)'))}, {quoted(put.replace('$', chr(92)))}, 'gi')"
    return out


def best_amount(plain: str, pack: DomainPack = DEFAULT_PACK) -> str:
    shape = quoted(X.amount_shape(pack))
    found = f"regexp_extract_all({plain}, {shape}, 0)"
    having = lambda k: f"list_filter({found}, lambda m: regexp_extract(m, {shape}, {k}) <> '')[1]"
    return f"coalesce({having(4)}, {having(1)}, {found}[1])"


def amount_fields(m: str, name: str, pack: DomainPack = DEFAULT_PACK) -> str:
    """value, uom and n of a matched amount as columns name_v, name_u, name_n."""
    shape = quoted(X.amount_shape(pack))
    unit = f"lower(regexp_extract({m}, {shape}, 3))"
    factor = "case " + " ".join(f"when {unit} = {quoted(u)} then {f}::double" for u, (_, f) in pack.units.items()) + " end"
    base = "case " + " ".join(f"when {unit} = {quoted(u)} then {quoted(b)}" for u, (b, _) in pack.units.items()) + " end"
    n = f"coalesce(try_cast(nullif(regexp_extract({m}, {shape}, 4), '') as int), try_cast(nullif(regexp_extract({m}, {shape}, 1), '') as int))"
    return f"round(regexp_extract({m}, {shape}, 2)::double * {factor}, 2) {name}_v, {base} {name}_u, {n} {name}_n"


def count_in(plain: str, pack: DomainPack = DEFAULT_PACK) -> str:
    """The count that a text's amounts leave, null for none."""
    shape = quoted(X.count_shape(pack))
    rest = f"regexp_replace({plain}, {quoted(X.amount_shape(pack))}, ' ', 'g')"
    found = f"regexp_extract_all({rest}, {shape}, 0)"
    first = lambda k: f"regexp_extract(list_filter({found}, lambda m: regexp_extract(m, {shape}, {k}) <> '')[1], {shape}, {k})"
    words = "case " + first(1) + " " + " ".join(f"when {quoted(w)} then {n}" for w, n in pack.count_words.items()) + " end"
    return f"coalesce({words}, {', '.join(f'try_cast({first(k)} as int)' for k in (2, 3, 4, 5))})"


def form(x: str, pack: DomainPack = DEFAULT_PACK) -> str:
    return "case " + " ".join(f"when regexp_matches({x}, {quoted(f'(?:{p})')}, 'i') then {quoted(n)}" for n, p in pack.forms) + " end"


def valid_ean(c: str) -> str:
    weighted = " + ".join(f"try_cast(substring({c}, {i}, 1) as int) * {3 if i % 2 == 0 else 1}" for i in range(1, 14))
    return f"(regexp_full_match({c}, '[0-9]{{13}}') and ({weighted}) % 10 = 0)"


def brand_key(x: str, pack: DomainPack = DEFAULT_PACK) -> str:
    exact = ", ".join(quoted(e.lower()) for e in sorted(pack.non_brand_exact))
    none = f"{x} is null or trim({x}) = '' or regexp_matches({x}, {quoted(f'(?:{pack.non_brand})')}, 'i') or lower(trim({x})) in ({exact})"
    return f"case when {none} then '' else regexp_replace(lower({x}), '[^\\p{{L}}\\p{{M}}\\p{{N}}]', '', 'g') end"


def attributes(pack: DomainPack = DEFAULT_PACK) -> str:
    """Common table expressions that end in attr, the attribute records of listings."""
    texts = {"n": "sku_name_chi", "b": "brand_name_chi", "p": "pack_size_chi", "o": "origin_chi", "s": "summary_chi", "d": "description_chi"}
    runs = " || ".join(f"regexp_extract_all({t}, '[0-9]+')" for t in "nspd")
    places = "case x " + " ".join(f"when {quoted(a)} then {quoted(b)}" for a, b in pack.origin_names.items()) + " else x end"
    codes = " || ".join(f"regexp_extract_all({t}, {quoted(p)}, 1)" for t in "ns" for p in (X.MARKED, X.BRACKETED))
    return f"""
    norm as (select sku_id, row_ord, {", ".join(f"{nfkc(c)} {k}" for k, c in texts.items())} from {FIRST}),
    cleaned as (select *, {clean("n", pack)} c, {clean("s", pack)} cs, {clean("p", pack)} cp from norm),
    plain as (select *, {best_amount(numbers_apart("c"), pack)} mn, {best_amount(numbers_apart("p"), pack)} mp, {best_amount(numbers_apart("s"), pack)} ms, {best_amount(numbers_apart("d"), pack)} md, {numbers_apart("c || ' ' || cp")} cc from cleaned),
    counted as (select *, {best_amount("cc", pack)} mc, {count_in("cc", pack)} told from plain),
    fields as (select *, {", ".join(amount_fields(f"m{k}", k, pack) for k in "npsdc")} from counted),
    base as (select sku_id, row_ord, n title, c clean_title, s summary, b brand_raw, {brand_key("b", pack)} brand_key,
        list_sort(list_distinct(list_filter(string_split(sku_id, '_') || {runs}, lambda e: {valid_ean("e")}))) ean,
        list_sort(list_distinct(list_filter({codes}, lambda e: length(e) between 4 and 6))) codes,
        coalesce(n_v, p_v, s_v, d_v) unit_value, case when mn is not null then n_u when mp is not null then p_u when ms is not null then s_u when md is not null then d_u end unit_uom,
        case when mn is not null then 'name' when mp is not null then 'pack_size' when ms is not null then 'summary' when md is not null then 'description' end unit_source,
        coalesce(case when mn is not null then n_n when mp is not null then p_n when ms is not null then s_n when md is not null then d_n end, c_n, told, 1) pack_count,
        coalesce({form("c", pack)}, {form("cs", pack)}, 'UNKNOWN') form, case when {form("c", pack)} is not null then 1.0 when {form("cs", pack)} is not null then 0.6 else 0.0 end::double form_conf,
        case when {form("c", pack)} is not null then 'name' when {form("cs", pack)} is not null then 'summary' end form_source,
        list_sort(list_distinct(list_transform(list_filter(list_transform(string_split_regex(o, '[/、,，]'), lambda x: {squeeze("x")}), lambda x: x <> ''), lambda x: {places}))) origin from fields),
    pool as (select e, arg_min(brand_key, row_ord) filter (where brand_key <> '') eb from (select unnest(ean) e, brand_key, row_ord from base) group by e),
    spread as (select a.sku_id, list_sort(list_distinct(list(p.e))) got from (select sku_id, brand_key, unnest(codes) code from base where len(ean) = 0) a join (select e, eb, right(e, k) code from pool, (values (4), (5), (6)) t(k)) p on p.code = a.code
        where a.brand_key = '' or coalesce(p.eb, '') = '' or p.eb = a.brand_key group by 1),
    wide as (select b.*, case when len(ean) > 0 then ean else coalesce(got, []) end ean_all, case when len(ean) > 0 then 'direct' when got is not null then 'propagated' end ean_source from base b left join spread s on s.sku_id = b.sku_id),
    prefixed as (select *, substring(list_min(ean_all), 1, 7) gs1 from wide),
    votes as (select gs1, brand_raw, count(*) v, min(row_ord) f from (select substring(unnest(ean), 1, 7) gs1, brand_raw, row_ord from base where brand_key <> '') group by 1, 2),
    owners as (select gs1, brand_raw gs1_brand from votes qualify row_number() over (partition by gs1 order by v desc, f, brand_raw) = 1),
    attr as (select sku_id, row_ord, title, clean_title, summary, brand_raw, brand_key, coalesce(gs1_brand, case when brand_key <> '' then brand_raw end) brand_canonical, case when gs1_brand is not null then 'gs1' when brand_key <> '' then 'field' end brand_source,
        case when gs1_brand is not null then 'GS1:' || p.gs1 else brand_key end brand_id, ean, ean_all, ean_source, p.gs1, unit_value, unit_uom, unit_source, pack_count, form, form_conf, form_source, origin from prefixed p left join owners o on o.gs1 = p.gs1)"""


def compatible(a: str = "a", b: str = "b") -> str:
    """The channels' prefilter."""
    unit = f"(case when {a}.unit_value is null or {b}.unit_value is null then true else {a}.unit_uom = {b}.unit_uom and {close(a, b)} end)"
    return f"({a}.form = 'UNKNOWN' or {b}.form = 'UNKNOWN' or {a}.form = {b}.form) and {unit} and {origins_meet(a, b)}"


def close(a: str, b: str) -> str:
    return f"coalesce(abs({a}.unit_value - {b}.unit_value) / nullif(greatest({a}.unit_value, {b}.unit_value), 0), 0) <= {DEFAULTS.unit_tolerance}"


def same_unit(a: str = "a", b: str = "b") -> str:
    return f"(case when {a}.unit_value is null or {b}.unit_value is null then {a}.unit_value is null and {b}.unit_value is null else {a}.unit_uom = {b}.unit_uom and {close(a, b)} end)"


def origins_meet(a: str, b: str) -> str:
    return f"(len({a}.origin) = 0 or len({b}.origin) = 0 or list_has_any({a}.origin, {b}.origin))"


def residual(x: str, brand: str, pack: DomainPack = DEFAULT_PACK) -> str:
    words = f"list_filter(string_split_regex(lower(coalesce({brand}, '')), '[^\\p{{L}}\\p{{N}}&.'']+'), lambda w: length(w) > 1)"
    ordered = f"list_transform(list_sort(list_transform({words}, lambda w: {{'k': -length(w), 'w': w}})), lambda z: '\\Q' || z.w || '\\E')"
    own = f"case when len({words}) > 0 then array_to_string({ordered}, '|') else '[^\\s\\S]' end"
    known = quoted(T.known_words(pack).removeprefix("(?i)"))
    return squeeze(f"regexp_replace(regexp_replace(lower({packfree(x, pack)}), {own}, ' ', 'g'), {known}, ' ', 'gi')")


def terms(pack: DomainPack = DEFAULT_PACK) -> str:
    """Common table expressions, after attr, that end in term: one row for each listing and distinct term (sku_id, grp, term), and listed: every listing."""
    nobody = "'NB:' || substring(sku_id, 1, 5) || ':' || form || ':' || coalesce(unit_value::varchar, '?') || coalesce(unit_uom, '?')"
    grams = " || ".join(f"flatten(list_transform(runs, lambda r: [substring(r, i, {k}) for i in range(1, length(r) - {k - 2})]))" for k in (2, 3, 4))
    known = quoted(T.known_words(pack).removeprefix("(?i)"))
    return f"""
    listed as (select sku_id, coalesce(nullif(brand_key, ''), nullif(brand_id, ''), {nobody}) grp, clean_title title, {residual("clean_title", "brand_raw", pack)} rest from attr),
    split as (select *, regexp_extract_all(rest, '[一-鿿]+') runs from listed),
    term as (select distinct sku_id, grp, t term from (select sku_id, grp, unnest(regexp_extract_all(rest, '[a-z]{{3,}}') || {grams}) t from split) where not regexp_matches(t, {known}, 'i'))"""


def mined() -> str:
    """Common table expressions, after term, that end in vocab (term, df) and sig (sku_id, grp, title, signature)."""
    t = DEFAULTS
    return f"""
    freq as (select term, count(*) df from term group by 1), sizes as (select grp, count(*) size from listed group by 1),
    splits as (select distinct term from (select x.grp, x.term, count(*) df, any_value(size) size from term x join sizes s on s.grp = x.grp group by 1, 2) where size >= {t.min_split_group} and df >= {t.min_brand_count} and df < size),
    common as (select f.term, f.df from freq f join splits s on s.term = f.term where f.df <= {t.max_global_df} * (select count(*) from listed)),
    vocab as (select c.term, c.df from common c where not exists (select 1 from common l where l.df = c.df and l.term <> c.term and contains(l.term, c.term))),
    hits as (select sku_id, list(x.term) l from term x join vocab v on v.term = x.term group by 1),
    sig as (select d.sku_id, d.grp, d.title, coalesce(list_sort(list_filter(l, lambda x: len(list_filter(l, lambda y: y <> x and contains(y, x))) = 0)), []) signature from listed d left join hits h on h.sku_id = d.sku_id)"""


def vetoes() -> str:
    """Common table expressions, after sig, that end in veto (t1, t2); alt, minimal and contra are its parts."""
    t = DEFAULTS
    return f"""
    big as (select grp from listed group by 1 having count(*) >= {t.min_alternative_group}), inbig as (select x.sku_id, x.grp, x.term from term x join big b on b.grp = x.grp join vocab v on v.term = x.term),
    often as (select grp, term from inbig group by 1, 2 having count(*) >= {t.min_brand_count}), kept as (select i.* from inbig i join often o on o.grp = i.grp and o.term = i.term),
    beside as (select distinct a.grp, a.term t1, b.term t2 from kept a join kept b on a.grp = b.grp and a.sku_id = b.sku_id and a.term < b.term),
    alt as (select a.term t1, b.term t2, count(*) support from often a join often b on a.grp = b.grp and a.term < b.term where not exists (select 1 from beside s where s.grp = a.grp and s.t1 = a.term and s.t2 = b.term) group by 1, 2),
    one as (select * from (select grp, sku_id, signature, term, replace({fold("title")}, term, '') rest from (select *, unnest(signature) term from sig)) where rest <> ''),
    minimal as (select distinct a.term t1, b.term t2 from one a join one b on a.grp = b.grp and a.rest = b.rest and a.term < b.term
        where len(list_filter(a.signature, lambda x: not list_contains(b.signature, x))) = 1 and len(list_filter(b.signature, lambda x: not list_contains(a.signature, x))) = 1 and not list_contains(b.signature, a.term) and not list_contains(a.signature, b.term)),
    pos as (select distinct a.sku_id sku_a, b.sku_id sku_b from (select sku_id, unnest(ean) e from attr) a join (select sku_id, unnest(ean) e from attr) b on a.e = b.e and a.sku_id < b.sku_id),
    sides as (select list_filter(x.signature, lambda q: not list_contains(y.signature, q)) xs, list_filter(y.signature, lambda q: not list_contains(x.signature, q)) ys from pos join sig x on x.sku_id = sku_a join sig y on y.sku_id = sku_b),
    contra as (select distinct least(x, y) t1, greatest(x, y) t2 from (select unnest(xs) x, ys from sides), unnest(ys) u(y)),
    veto as (select t1, t2 from (select t1, t2 from alt where support >= {t.veto_support} union select t1, t2 from minimal) v where not exists (select 1 from contra c where c.t1 = v.t1 and c.t2 = v.t2))"""


def select(body: str, *parts: str) -> str:
    """A whole statement: the attribute records, further parts in their order, and the query."""
    return "with " + ",".join([attributes(), *parts]) + " " + body
