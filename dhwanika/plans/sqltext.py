"""Pieces of DuckDB SQL for the oracles, written independently of the Column expressions."""

from __future__ import annotations

from ..functions import normalization as N
from ..functions import phonetics as P

# Characters of the test tables that NFKC changes and NFC doesn't, with their forms.
WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
PLAIN = "".join(chr(c) for c in range(0x21, 0x7F))
BLANKS = "[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\p{Z}]"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{BLANKS}+', ' ', 'g'), ' ')"


def digits(x: str) -> str:
    found = [chr(b + i) for b in (0x660, 0x6F0, 0x966, 0x9E6, 0xA66, 0xAE6, 0xB66, 0xBE6, 0xC66, 0xCE6, 0xD66, 0xFF10) for i in range(10)]
    return f"translate({x}, '{''.join(found)}', '{'0123456789' * 12}')"


def brackets(x: str) -> str:
    return f"regexp_replace({x}, {q(N.BRACKETS)}, '', 'g')"


def punctuation(x: str, dandas: bool = False) -> str:
    signs = N.PUNCTUATION.replace("\n", "").replace("\t", "") + (N.DANDAS if dandas else "")
    return f"translate({x}, {q(signs)} || chr(10) || chr(9), '')"


def number(n: str, w: N.NumberWords) -> str:
    """Words of a non-negative integer below 10**14."""
    table = "[" + ", ".join(q(x) for x in w.below_hundred()) + "]"
    crore, lakh, thousand, hundred = w.scale

    def group(e: str) -> str:
        part = lambda v, label: f"CASE WHEN {v} > 0 THEN {table}[{v} + 1] || ' {label}' END"
        parts = [part(f"({e} // 100000)", lakh), part(f"({e} % 100000 // 1000)", thousand), part(f"({e} % 1000 // 100)", hundred), f"CASE WHEN {e} % 100 > 0 THEN {table}[{e} % 100 + 1] END"]
        return f"array_to_string(list_filter([{', '.join(parts)}], lambda z: z IS NOT NULL), ' ')"

    high, low = f"({n} // 10000000)", f"({n} % 10000000)"
    return (
        f"CASE WHEN {n} = 0 THEN {q(w.zero)} ELSE array_to_string(list_filter([CASE WHEN {high} > 0 THEN {group(high)} || ' {crore}' END, "
        f"CASE WHEN {low} > 0 THEN {group(low)} END], lambda z: z IS NOT NULL), ' ') END"
    )


def spoken(x: str, w: N.NumberWords) -> str:
    """Runs of ASCII digits (up to 14) replaced by their words."""
    zipped = f"list_zip(string_split_regex({x}, '[0-9]+'), regexp_extract_all({x}, '[0-9]+'))"
    return f"array_to_string(list_transform({zipped}, lambda p: p[1] || CASE WHEN p[2] IS NULL THEN '' ELSE {number('CAST(p[2] AS BIGINT)', w)} END), '')"


def normalized(x: str, lang: str) -> str:
    w = N.LANGUAGES[lang]
    t = f"nfc_normalize({x})"
    if lang == "hi":
        t = f"replace({t}, {q(N.NUKTA)}, '')"
    t = spoken(brackets(digits(t)), w)
    if lang == "or":
        t = f"replace({t}, {q(N.ODIA_NUKTA)}, '')"
    t = squeeze(punctuation(t, lang != "hi"))
    return f"CASE WHEN {x} IS NOT NULL THEN coalesce(nullif({t}, ''), 'NA') END"


def language(lang: str) -> str:
    name = f"lower(regexp_replace({lang}, '^{BLANKS}+|{BLANKS}+$', '', 'g'))"
    listed = lambda k: ", ".join(q(x) for x in N.LANGUAGE_NAMES[k])
    return f"CASE WHEN {name} IN ({listed('te')}) THEN 'te' WHEN {name} IN ({listed('or')}) THEN 'or' ELSE 'hi' END"


def dispatched(x: str, lang: str) -> str:
    code = language(lang)
    return f"CASE {code} WHEN 'te' THEN {normalized(x, 'te')} WHEN 'or' THEN {normalized(x, 'or')} ELSE {normalized(x, 'hi')} END"


def nfkc(x: str) -> str:
    """NFKC of what the test tables hold: widths, ligatures, three dots, blanks, canonical composition."""
    t = f"translate({x}, {q(WIDE)}, {q(PLAIN)})"
    for a, b in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("…", "...")):
        t = f"replace({t}, '{a}', '{b}')"
    blank = "".join(chr(c) for c in (0xA0, 0x2002, 0x2003, 0x2007, 0x2009, 0x202F, 0x3000))
    return f"nfc_normalize(translate(replace({t}, '‑', '‐'), '{blank}', '{' ' * len(blank)}'))"


NUKTA_FORMS = dict(zip("क़ख़ग़ज़ड़ढ़फ़य़ऩऱऴ", "कखगजडढफयनरळ", strict=False))


def no_nukta(x: str) -> str:
    """Nukta folded after NFC: the sign out, and the three letters that NFC composes taken apart."""
    return f"nfc_normalize(translate(replace(nfc_normalize({x}), {q(N.NUKTA)}, ''), chr(2345) || chr(2353) || chr(2356), 'नरळ'))"


def norm_word(x: str) -> str:
    t = f"translate({no_nukta(f"translate(nfc_normalize({x}), chr(8204) || chr(8205) || chr(65279), '')")}, {q(P.VARIANTS[0])}, {q(P.VARIANTS[1])})"
    t = f"translate({t}, {q(P.SPACED)}, '{' ' * len(P.SPACED)}')"
    return f"coalesce({squeeze(f"regexp_replace({t}, '{BLANKS}*-{BLANKS}*', '-', 'g')")}, '')"


def phon(canonical: str) -> str:
    """Phoneme string by a fold over the characters: RE2 has neither look-around nor back-references."""
    cons, vow, sign = (
        {c: k for k, cs in g.items() for c in cs} for g in (P.CONSONANTS, P.VOWELS, P.SIGNS)
    )
    vow |= dict.fromkeys(P.VOCALIC_R, "ri")
    sign |= {P.VOCALIC_R_SIGN: "ri"}
    case = lambda x, table: "CASE " + x + " " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table.items()) + " ELSE '' END"
    inside = lambda x, table: f"contains({q(''.join(table))}, {x})"
    chars = f"string_split(translate({canonical}, ' -', ''), '')"
    prev, cur, nxt = "c[i - 1]", "c[i]", "c[i + 1]"
    # the sound of the character at i, which depends on its neighbours only
    sound = (
        f"CASE WHEN {inside(cur, cons)} THEN {case(cur, cons)} || CASE WHEN i < len(c) AND NOT contains({q(P.VIRAMA + ''.join(sign))}, {nxt}) THEN 'a' ELSE '' END "
        f"WHEN {inside(cur, sign)} THEN CASE WHEN i > 1 AND {inside(prev, cons)} THEN {case(cur, sign)} ELSE '' END "
        f"WHEN {inside(cur, vow)} THEN {case(cur, vow)} WHEN {cur} = {q(P.ANUSVARA)} THEN 'n' WHEN {cur} = {q(P.VISARGA)} THEN 'H' "
        f"WHEN regexp_matches({cur}, '^[\\p{{Nd}}a-zA-Z]$') THEN upper({cur}) ELSE '' END"
    )
    joined = f"array_to_string(list_transform(range(1, len(c) + 1), lambda i: {sound}), '')"
    single = f"list_reduce(string_split({joined}, ''), lambda s, x: CASE WHEN right(s, 1) = x THEN s ELSE s || x END, '')"
    body = f"regexp_replace(regexp_replace({single}, 'H$', ''), 'n$', '')"
    return f"CASE WHEN translate({canonical}, ' -', '') = '' THEN '' ELSE list_transform([{chars}], lambda c: {body})[1] END"


def sub_cost(a: str, b: str) -> str:
    near = ", ".join(q(x) for p in P.NEAR for x in (p, p[::-1]))
    va, vb = f"contains('{P.VOWEL_SOUNDS}', {a})", f"contains('{P.VOWEL_SOUNDS}', {b})"
    return (
        f"CAST(CASE WHEN {a} = {b} THEN 0 WHEN {a} || {b} IN ({near}) THEN {P.NEAR_COST} WHEN {va} AND {vb} THEN {P.VOWEL_COST} "
        f"WHEN {va} <> {vb} THEN {P.MIXED_COST} ELSE {P.OTHER_COST} END AS DOUBLE)"
    )


def indel_cost(c: str) -> str:
    return f"CAST(CASE WHEN contains('{P.LIGHT}', {c}) THEN {P.LIGHT_COST} ELSE {P.FULL_COST} END AS DOUBLE)"


def pdist(a: str, b: str) -> str:
    """Weighted edit distance of two non-empty strings by nested folds over places."""
    places = lambda x: f"list_transform(range(1, len({x}) + 1), lambda i: [CAST(i AS DOUBLE)])"
    at = lambda k: f"CAST({k}[1] AS BIGINT)"
    own, other = f"substr({a}, {at('p')}, 1)", f"substr({b}, {at('k')}, 1)"
    start = f"list_reduce({places(b)}, lambda r, k: list_append(r, r[len(r)] + {indel_cost(other)}), [CAST(0 AS DOUBLE)])"
    cell = f"least(r[{at('k')} + 1] + {indel_cost(own)}, cur[len(cur)] + {indel_cost(other)}, r[{at('k')}] + {sub_cost(own, other)})"
    row = f"list_reduce({places(b)}, lambda cur, k: list_append(cur, {cell}), [r[1] + {indel_cost(own)}])"
    full = f"list_reduce({places(a)}, lambda r, p: {row}, {start})"
    return f"CASE WHEN {a} = {b} THEN CAST(0 AS DOUBLE) ELSE list_last({full}) END"


def psim(d: str, a: str, b: str) -> str:
    return f"greatest(0.0, 1.0 - {d} / greatest(len({a}), len({b}), 1))"
