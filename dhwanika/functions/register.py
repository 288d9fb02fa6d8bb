"""SQL functions of this library for a session.

The Unicode forms, the normaliser of a text and the phoneme distance are Arrow UDFs; all else is registered as SQL functions with a
SQL body, which the optimiser inlines and sees through.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import normalization as N
from . import phonetics as P
from .unicode import WHITE, bare_word, nfc, nfkc, odd_digits, strip_nukta


def _q(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\t", "\\t") + "'"


def _listed(values: list[str]) -> str:
    return ", ".join(map(_q, values))


def _squeeze(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, r'{WHITE}+', ' '), '^ | $', '')"


def _number(d: str, w: N.NumberWords) -> str:
    """Words of a string of ASCII digits: groups of seven, folded with the word for ten million."""
    table = f"array({_listed(w.below_hundred())})"
    crore, lakh, thousand, hundred = w.scale

    def group(n: str) -> str:
        part = lambda v, label: f"CASE WHEN {v} > 0 THEN concat(get({table}, int({v})), {_q(' ' + label)}) END"
        return (
            f"concat_ws(' ', {part(f'({n} div 100000)', lakh)}, {part(f'({n} % 100000 div 1000)', thousand)}, "
            f"{part(f'({n} % 1000 div 100)', hundred)}, CASE WHEN {n} % 100 > 0 THEN get({table}, {n} % 100) END)"
        )

    count = f"int(ceil(length({d}) / 7))"
    groups = f"transform(sequence(0, {count} - 1), g -> int(substring(lpad({d}, {count} * 7, '0'), g * 7 + 1, 7)))"
    fold = (
        f"aggregate({groups}, '', (said, n) -> CASE WHEN said = '' THEN {group('n')} "
        f"ELSE concat(said, {_q(' ' + crore)}, CASE WHEN n > 0 THEN concat(' ', {group('n')}) ELSE '' END) END)"
    )
    return f"coalesce(nullif({fold}, ''), {_q(w.zero)})"


def _phon(word: str) -> str:
    cons, sign = "".join(P.CONSONANTS.values()), "".join(P.SIGNS.values()) + P.VOCALIC_R_SIGN
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    moved = "".join(chr(0xE041 + i) for i in range(26))
    vocalic = chr(0xE000)
    sounds = lambda groups: "".join(k * len(v) for k, v in groups.items())
    origin = cons + "".join(P.VOWELS.values()) + "".join(P.SIGNS.values()) + P.VOCALIC_R + P.VOCALIC_R_SIGN + P.ANUSVARA + P.VISARGA + P.VIRAMA
    target = sounds(P.CONSONANTS) + sounds(P.VOWELS) + sounds(P.SIGNS) + vocalic * 3 + "nH"
    t = f"translate(translate({word}, {_q(' -' + vocalic)}, ''), {_q(upper + upper.lower() + moved)}, {_q(moved * 2)})"
    t = f"regexp_replace(regexp_replace({t}, r'(?<![{cons}])[{sign}]', ''), r'([{cons}])(?![{P.VIRAMA}{sign}]|\\z)', '$1a')"
    t = f"replace(translate({t}, {_q(origin)}, {_q(target)}), {_q(vocalic)}, 'ri')"
    t = f"translate(regexp_replace({t}, r'[^A-Za-z{moved}\\p{{Nd}}{odd_digits()}]', ''), {_q(moved)}, {_q(upper)})"
    return f"regexp_replace(regexp_replace(regexp_replace({t}, r'(.)\\1+', '$1'), r'H\\z', ''), r'n\\z', '')"


def register(spark: SparkSession) -> list[str]:
    """Register all functions; returns their names."""
    from .phonetics import pdist

    udfs = {"nfc": nfc, "nfkc": nfkc, "strip_nukta": strip_nukta, "bare_word": bare_word, "pdist": pdist, "normalize_as": N.normalized}
    for name, f in udfs.items():
        spark.udf.register(name, f)
    near = _listed([x for p in P.NEAR for x in (p, p[::-1])])
    by = lambda k: _listed(N.LANGUAGE_NAMES[k])
    name = f"lower(regexp_replace(lang, r'^{WHITE}+|{WHITE}+$', ''))"
    spaced = f"translate(translate(bare_word(w), {_q(P.VARIANTS[0])}, {_q(P.VARIANTS[1])}), {_q(P.SPACED)}, {_q(' ' * len(P.SPACED))})"
    tight = f"regexp_replace({spaced}, r'{WHITE}*-{WHITE}*', '-')"
    vowel = lambda x: f"instr('{P.VOWEL_SOUNDS}', {x}) > 0"
    bodies = {
        "squeeze_text": ("t STRING", "STRING", _squeeze("t")),
        "canonical_text": ("t STRING", "STRING", _squeeze("nfkc(coalesce(t, ''))")),
        "language_code": ("lang STRING", "STRING", f"CASE WHEN {name} IN ({by('te')}) THEN 'te' WHEN {name} IN ({by('or')}) THEN 'or' ELSE 'hi' END"),
        **{f"number_words_{k}": ("d STRING", "STRING", _number("d", w)) for k, w in N.LANGUAGES.items()},
        **{f"normalize_{k}": ("t STRING", "STRING", f"normalize_as(t, '{k}')") for k in N.LANGUAGES},
        "normalize_text": ("t STRING, lang STRING", "STRING", "normalize_as(t, language_code(lang))"),
        "norm_word": ("w STRING", "STRING", f"coalesce({_squeeze(tight)}, '')"),
        "phon": ("w STRING", "STRING", _phon("norm_word(w)")),
        "skeleton": ("w STRING", "STRING", "regexp_replace(phon(w), '[^A-Z]', '')"),
        "phoneme_sub_cost": (
            "a STRING, b STRING", "DOUBLE",
            f"CASE WHEN a = b THEN 0D WHEN a || b IN ({near}) THEN {P.NEAR_COST}D WHEN {vowel('a')} AND {vowel('b')} THEN {P.VOWEL_COST}D "
            f"WHEN ({vowel('a')}) <> ({vowel('b')}) THEN {P.MIXED_COST}D ELSE {P.OTHER_COST}D END",
        ),
        "phoneme_indel_cost": ("c STRING", "DOUBLE", f"CASE WHEN instr('{P.LIGHT}', c) > 0 THEN {P.LIGHT_COST}D ELSE {P.FULL_COST}D END"),
        "psim": (
            "a STRING, b STRING", "DOUBLE",
            "CASE WHEN a = '' AND b = '' THEN 1D WHEN a IS NULL OR b IS NULL THEN NULL ELSE greatest(0D, 1D - pdist(a, b) / greatest(length(a), length(b), 1)) END",
        ),
    }
    for fn, (args, kind, body) in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {fn}({args}) RETURNS {kind} RETURN {body}")
    return [*udfs, *bodies]
