"""SQL fragments (DuckDB) that state what the column expressions compute."""

from __future__ import annotations

from sitewright.functions.stop_lists import STOP_LISTS
from sitewright.functions.words import MIN_STEM, SUFFIX_RULES


def stop_words(code: str) -> tuple[str, ...]:
    return STOP_LISTS[code]


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(set(words)))


def fix_http(x: str) -> str:
    schemed = f"(case when contains({x}, 'http') then {x} else 'http://' || {x} end)"
    return (
        f"(case when {x} = '' or {x} is null then null "
        f"when right({schemed}, 1) = '/' then {schemed} else {schemed} || '/' end)"
    )


def email_url(x: str) -> str:
    return f"coalesce(regexp_extract({x}, '@([A-Za-z.]+)', 1), '')"


def clean(x: str, min_length: int = 3, separator: str = "") -> str:
    words = f"string_split_regex(regexp_replace({x}, '[^A-Za-z ]+', '{separator}', 'g'), ' +')"
    return f"lower(array_to_string(list_filter({words}, lambda w: length(w) >= {min_length}), ' '))"


def without(x: str, stop) -> str:
    return f"array_to_string(list_filter(string_split_regex({x}, ' +'), lambda w: w not in ({quoted(stop)})), ' ')"


def no_stop(x: str, lang: str, primary: str = "de", secondary: str = "en") -> str:
    both = set(stop_words(primary)) | set(stop_words(secondary))
    return (
        f"(case when {lang} = '{primary}' then {without(x, both)} "
        f"when {lang} = '{secondary}' then {without(x, stop_words(secondary))} end)"
    )


def stem(x: str, lang: str, codes=("de", "en")) -> str:
    parts = []
    for code in codes:
        rules = SUFFIX_RULES[code]
        names = sorted((s for s, _ in rules), key=len, reverse=True)
        suffix = f"regexp_extract(w, '^.{{{MIN_STEM},}}?({'|'.join(names)})$', 1)"
        swap = " ".join(f"when '{s}' then '{r}'" for s, r in rules if r)
        tail = f"case {suffix} {swap} else '' end" if swap else "''"
        word = f"substr(w, 1, length(w) - length({suffix})) || {tail}"
        parts.append(
            f"when {lang} = '{code}' then array_to_string(list_transform(string_split_regex({x}, ' +'), lambda w: {word}), ' ')"
        )
    return f"(case {' '.join(parts)} end)"


def word_count(x: str) -> str:
    pieces = f"string_split_regex(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'), '\\s+')"
    return f"len(list_filter({pieces}, lambda w: w <> ''))"


def tokens(x: str, min_length: int = 2) -> str:
    return f"list_filter(string_split_regex(lower({x}), '[^\\pL\\pN_]+'), lambda w: length(w) >= {min_length})"


def decode(x: str) -> str:
    for entity, char in (("quot", "'\"'"), ("middot", "'·'"), ("copy", "'©'"), ("lt", "'<'"), ("gt", "'>'")):
        x = f"replace({x}, '&{entity};', {char})"
    return f"replace({x}, '&amp;', '&')"


TAG = "</?[A-Za-z][^>]*>|<[!?][^>]*>"


def drop_blocks(x: str, names=("script", "style", "comment", "head", "title")) -> str:
    for name in names:
        pattern = "(?s)<!--.*?-->" if name == "comment" else f"(?is)<{name}\\b.*?</{name}\\s*>"
        x = f"regexp_replace({x}, '{pattern}', '', 'g')"
    return x


def visible(x: str) -> str:
    shown = f"regexp_replace(regexp_replace({drop_blocks(x)}, '{TAG}', chr(1), 'g'), '\\x01+', ' ', 'g')"
    return f"regexp_replace({decode(shown)}, '\\s{{3,}}', ' ', 'g')"


def page_text(x: str) -> str:
    return f"trim({visible(visible(x))})"


def plain(x: str) -> str:
    bare = f"regexp_replace({drop_blocks(x, ('script', 'comment'))}, '{TAG}', '', 'g')"
    return f"trim(regexp_replace({decode(bare)}, '\\s+', ' ', 'g'))"


def number(hashed: str, digits: int = 15) -> str:
    return f"('0x' || substr({hashed}, 1, {digits}))::BIGINT"


def key_hash(key: str, seed: int = 22494) -> str:
    return f"md5(concat_ws(':', {key}, {seed}))"


def trigrams(x: str) -> str:
    flat = f"regexp_replace(lower({x}), '[\\s0-9!-/:-@\\[-`{{-~]+', ' ', 'g')"
    parts = [f"regexp_extract_all(substr({flat}, {i}), '(?s)...')" for i in (1, 2, 3)]
    return f"list_concat(list_concat({parts[0]}, {parts[1]}), {parts[2]})"


# Named inputs, to be put in front of a query with ``using``.
INPUTS: dict[str, str] = {
    "url_rows": """
        select page_id, cast(page_id as varchar) as key,
               case when page_id % 7 = 0 then null
                    when page_id % 13 = 5 then ''
                    when page_id % 3 = 1 then regexp_replace(url, '^https?://', '')
                    when page_id % 3 = 2 then regexp_replace(url, '/$', '')
                    else url end as url
        from pages""",
    "page_status": """
        select page_id, url,
               case when page_id % 5 = 0 then 404 when page_id % 11 = 0 then null else 200 end as status
        from pages""",
    "rounds": """
        select page_id, url, html,
               case when page_id % 4 <> 0 then html end as html_r1,
               case when page_id % 8 <> 0 then html end as html_r2
        from pages""",
    "companies": """
        select c_custkey as btw,
               'Firm   ' || c_name || chr(10) || '  ' || c_mktsegment as cur_firm,
               case when c_custkey % 17 <> 0 then c_custkey % 2 end as inno5,
               case when c_custkey % 3 <> 0 then 'www.' || lower(c_mktsegment) || c_custkey || '.example.com' end as cur_web,
               case c_custkey % 5 when 2 then 'info@' || lower(c_mktsegment) || '.example.org'
                    when 3 then 'info@my-firm' || c_custkey || '.be' when 4 then 'no address' end as cur_email,
               case when c_custkey % 4 > 1 then 'http://site' || c_custkey || '.example.net/' end as web,
               case when c_custkey % 2 = 1 then 'a.b@shop.example.com' end as email,
               'Main street ' || c_custkey || ' (bus ' || c_nationkey || ')' as street,
               1000 + c_nationkey * 10 as main_zip,
               case when c_custkey % 3 <> 1 then 1000 + c_custkey % 9000 end as activity_zip
        from customer""",
    "nav": """
        select p.page_id, p.url, p.html, regexp_extract(p.html, '<html lang="([a-z]+)"', 1) as language,
               a.url as u1, b.url as u2, c.url as u3, a.page_id as t1
        from (select *, count(*) over () as n from pages) p
        join pages a on a.page_id = (7 * p.page_id + 3) % p.n
        join pages b on b.page_id = (11 * p.page_id + 5) % p.n
        join pages c on c.page_id = (13 * p.page_id + 1) % p.n""",
    "linked": """
        select page_id, url, language, t1,
               replace(html, '</body>', case page_id % 6
                   when 0 then '<a hreflang="de" href="' || u1 || '">Deutsch</a>'
                   when 1 then '<a hreflang="de" href="' || u1 || '">Deutsch</a><a hreflang="de-be" href="' || u2
                        || '?be">DE</a><a class="x" href=''' || u3 || ''' hreflang="de">D</a>'
                   when 2 then '<a href="' || u1 || '">Kies  de </a><a href="' || u2 || '">en</a><a href="' || u3 || '">x</a>'
                   when 3 then '<a href="' || u3 || '">other</a>'
                   when 4 then '<a href="' || u1 || '"> <b>Cont</b>act us</a><a href="' || u2 || '">Vestigingen</a>'
                   else '<a href="..' || page_id || '.html.">Locaties</a>' end
                   || case when page_id % 3 = 0 then '<p>Teststraat ' || (10000 + page_id) || '</p>' else '' end
                   || '</body>') as html
        from nav""",
    "links": f"""
        select page_id, url, language, t1, cast(i - 1 as integer) as position,
               coalesce(nullif(regexp_extract(e, '(?is)^<[^>]*\\shref\\s*=\\s*"([^"]*)"', 1), ''),
                        regexp_extract(e, '(?is)^<[^>]*\\shref\\s*=\\s*''([^'']*)''', 1)) as href,
               trim(lower({decode(f"regexp_replace(e, '{TAG}', '', 'g')")})) as text,
               nullif(regexp_extract(e, '(?is)^<[^>]*\\shreflang\\s*=\\s*"([^"]*)"', 1), '') as hreflang
        from (select page_id, url, language, t1, unnest(es) as e, generate_subscripts(es, 1) as i
              from (select page_id, url, language, t1,
                           list_filter(regexp_extract_all({drop_blocks("html", ("script", "style", "comment"))},
                               '(?is)<a\\s[^>]*>.*?</a\\s*>'), lambda e: regexp_matches(e, '(?is)^<[^>]*\\shref\\s*=')) as es
                    from linked))""",
    "upages": f"""
        select norm, arg_min(page_id, url) as page_id, arg_min(html, url) as html
        from (select page_id, url, html, {fix_http("url")} as norm from pages) group by norm""",
    "ulinked": f"""
        select norm, arg_min(page_id, url) as page_id, arg_min(html, url) as html, arg_min(language, url) as language
        from (select *, {fix_http("url")} as norm from linked) group by norm""",
    "framed": """
        select page_id, url, u1, u2, html as base_html,
               replace(replace(html, '<body>', '<body>'
                       || case when page_id % 2 = 0 then '<div id="cookiebar">We use <div class="x">inner</div> cookies</div>' else '' end
                       || case when page_id % 5 = 1 then '<DIV CLASS=''my-popup big''>Join <div>now</div></DIV>' else '' end),
                   '</body>',
                   case when page_id % 3 = 0 then '<frame src="' || u1 || '"><frame src="http://nowhere.example.com/"><frame src="'
                        || u2 || '">' else '' end || '</body>') as html
        from nav""",
    "corpus": f"""
        select doc_id, lang, source, text from (
            select doc_id, lang, source, {no_stop(clean("text"), "lang")} as text
            from documents where lang in ('de', 'en'))
        where {word_count("text")} > 20""",
    "labelled": "select c.*, l.quality as label from corpus c join labels l using (doc_id)",
    "words": f"select doc_id, unnest({tokens('text')}) as term from corpus",
    "proba": """
        select doc_id, quality as label, n_chars, (n_chars % 997) / 997.0::double as p,
               case when (n_chars % 997) / 997.0::double > 0.5 then 1 else 0 end as prediction
        from documents join labels using (doc_id)""",
    "coefficients": """
        select term as feature, round(sum(case when label = 1 then 1.0::double else -1.0::double end)
                                      / count(*), 6) as coef
        from (select distinct doc_id, label, term from
              (select doc_id, label, unnest(string_split(text, ' ')) as term from labelled))
        group by term having count(*) >= 5""",
}

NEEDS = {
    "linked": ("nav",),
    "links": ("linked",),
    "ulinked": ("linked",),
    "framed": ("nav",),
    "labelled": ("corpus",),
    "words": ("corpus",),
    "coefficients": ("labelled",),
}


def using(names: str, body: str) -> str:
    """``body`` with the named inputs, and those they need, as common table expressions."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, ()):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        add(name)
    head = ",\n".join(f"{name} as materialized ({INPUTS[name]})" for name in ordered)
    return f"with {head}\n{body}"
