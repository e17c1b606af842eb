"""The English (Porter 2) stemmer as SQL over a table of words, for Spark and for DuckDB: a layer of columns for each step."""

from __future__ import annotations

#: Words with stems of their own, words that stay, beginnings that set the first region, and suffixes.
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
KEPT = ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")
KEPT_AFTER_PLURALS = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")

_SHORT = "(^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$"
_REGION = "^[^aeiouy]*[aeiouy]+[^aeiouy]"


def _in(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _case(table: dict[str, str]) -> str:
    return " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())


def _suffix(words) -> str:
    return "(" + "|".join(sorted(words, key=len, reverse=True)) + ")$"


def _layers(duck: bool) -> list[dict[str, str]]:
    """The columns that each layer adds; a column of a name that is there replaces it."""
    match = (lambda x, p: f"regexp_matches({x}, '{p}')") if duck else (lambda x, p: f"{x} RLIKE '{p}'")
    marked = "regexp_replace(regexp_replace(word, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g')" if duck else "regexp_replace(regexp_replace(word, '^y', 'Y'), '([aeiouy])y', '$1Y')"
    cut = lambda x, n: f"substr({x}, 1, length({x}) - {n})"
    region = lambda x: f"CASE WHEN regexp_extract({x}, '{_REGION}', 0) = '' THEN length({x}) ELSE length(regexp_extract({x}, '{_REGION}', 0)) END"
    at = "length(w) - length(suf)"
    base = "substr(w, 1, length(w) - length(suf))"
    return [
        {"w": marked},
        {"p1": f"CASE WHEN {match('w', '^(gener|commun|arsen)')} THEN length(regexp_extract(w, '^(gener|commun|arsen)', 1)) ELSE {region('w')} END"},
        {"rest": "substr(w, p1 + 1)"},
        {"p2": f"p1 + {region('rest')}"},
        # 1a: plurals
        {"w": f"CASE WHEN {match('w', 'sses$')} THEN {cut('w', 2)} WHEN {match('w', '^.?(ied|ies)$')} THEN {cut('w', 1)} WHEN {match('w', '(ied|ies)$')} THEN {cut('w', 2)} WHEN {match('w', '(us|ss)$')} THEN w WHEN {match('w', '[aeiouy].+s$')} THEN {cut('w', 1)} ELSE w END"},
        {"kept": f"w IN ({_in(KEPT_AFTER_PLURALS)})", "suf": "regexp_extract(w, '(eedly|eed|ingly|edly|ing|ed)$', 1)"},
        # 1b: past and present participles
        {"cut_off": f"suf IN ('ed', 'edly', 'ing', 'ingly') AND {match(base, '[aeiouy]')}", "b": base},
        {"w": f"CASE WHEN suf IN ('eed', 'eedly') AND {at} >= p1 THEN concat(b, 'ee') WHEN cut_off AND {match('b', '(at|bl|iz)$')} THEN concat(b, 'e') WHEN cut_off AND {match('b', '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$')} THEN {cut('b', 1)} WHEN cut_off AND length(b) <= p1 AND {match('b', _SHORT)} THEN concat(b, 'e') WHEN cut_off THEN b ELSE w END"},
        # 1c: y
        {"w": f"CASE WHEN {match('w', '.[^aeiouy][yY]$')} THEN concat({cut('w', 1)}, 'i') ELSE w END"},
        {"suf": f"regexp_extract(w, '{_suffix([*STEP_2, 'ogi', 'li'])}', 1)"},
        {"w": f"CASE WHEN suf = '' OR {at} < p1 THEN w WHEN suf = 'ogi' THEN CASE WHEN {match('w', 'logi$')} THEN {cut('w', 1)} ELSE w END WHEN suf = 'li' THEN CASE WHEN {match('w', '[cdeghkmnrt]li$')} THEN {base} ELSE w END ELSE concat({base}, CASE suf {_case(STEP_2)} END) END"},
        {"suf": f"regexp_extract(w, '{_suffix([*STEP_3, 'ative'])}', 1)"},
        {"w": f"CASE WHEN suf = '' OR {at} < p1 THEN w WHEN suf = 'ative' THEN CASE WHEN {at} >= p2 THEN {base} ELSE w END ELSE concat({base}, CASE suf {_case(STEP_3)} END) END"},
        {"suf": f"regexp_extract(w, '{_suffix([*STEP_4, 'ion'])}', 1)"},
        {"w": f"CASE WHEN suf = '' OR {at} < p2 THEN w WHEN suf = 'ion' THEN CASE WHEN {match('w', '[st]ion$')} THEN {base} ELSE w END ELSE {base} END"},
        {"w": f"CASE WHEN {match('w', 'e$')} AND (length(w) > p2 OR length(w) > p1 AND NOT {match(cut('w', 1), _SHORT)}) THEN {cut('w', 1)} WHEN {match('w', 'll$')} AND length(w) > p2 THEN {cut('w', 1)} ELSE w END"},
    ]


def stem_sql(words: str, duck: bool = False, keep: tuple[str, ...] = ()) -> str:
    """(word, stem) for the rows (word) of the SQL table or subquery words, with its columns keep, which no layer may name.
    Words are in lower case, without apostrophes.
    """
    inner, columns = f"SELECT {', '.join(['word', *keep])} FROM {words} AS w0", ["word", *keep]
    for i, layer in enumerate(_layers(duck)):
        new = [c for c in layer if c not in columns]
        parts = [f"{layer[c]} AS {c}" if c in layer else c for c in columns] + [f"{layer[c]} AS {c}" for c in new]
        if "kept" in layer:
            parts.append("w AS whole")
            new = [*new, "whole"]
        inner = f"SELECT {', '.join(parts)} FROM ({inner}) AS l{i}"
        columns += new
    final = f"CASE word {_case(SPECIAL)} ELSE CASE WHEN length(word) <= 2 OR word IN ({_in(KEPT)}) THEN word WHEN kept THEN whole ELSE replace(w, 'Y', 'y') END END"
    return f"SELECT {', '.join(['word', *keep])}, {final} AS stem FROM ({inner}) AS l"
