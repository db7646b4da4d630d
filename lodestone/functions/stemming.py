"""English stems by the second version of Porter's algorithm, as steps of SQL that stay in the JVM.

Each step is an expression over the word so far (w) and the starts of its two regions (p1, p2).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The algorithm's word lists and endings.
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
FINISHED = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
STEP_2 = {
    "ational": "ate", "fulness": "ful", "iveness": "ive", "ization": "ize", "ousness": "ous", "biliti": "ble", "lessli": "less", "tional": "tion", "alism": "al", "aliti": "al", "ation": "ate", "entli": "ent",
    "fulli": "ful", "iviti": "ive", "ousli": "ous", "abli": "able", "alli": "al", "anci": "ance", "ator": "ate", "enci": "ence", "izer": "ize", "bli": "ble", "ogi": "og", "li": "",
}
STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")

_REGION = "coalesce(length(nullif(regexp_extract({0}, '^[^aeiouy]*[aeiouy]+[^aeiouy]', 0), '')), length({0}))"
_SHORT = "({0} RLIKE '[^aeiouy][aeiouy][^aeiouywxY]$' OR {0} RLIKE '^[aeiouy][^aeiouy]$')"


def _endings(table: dict[str, str], extra: dict[str, str], region: str = "p1") -> str:
    """The longest ending of ``table`` that w has gives way, where it lies in its region and ``extra`` holds."""
    cases = [f"WHEN w RLIKE '{e}$' THEN CASE WHEN length(w) - {len(e)} >= {'p2' if e == 'ative' else region} AND {extra.get(e, 'true')} THEN left(w, length(w) - {len(e)}) || '{to}' ELSE w END" for e, to in sorted(table.items(), key=lambda x: -len(x[0]))]
    return f"CASE {' '.join(cases)} ELSE w END"


#: (column, expression) in order; ``done`` words stay as they are from there on.
STEPS: tuple[tuple[str, str], ...] = (
    ("w", "regexp_replace(regexp_replace(word, '^y', 'Y'), '([aeiouy])y', '$1Y')"),
    ("p1", f"CASE WHEN w RLIKE '^(gener|arsen)' THEN 5 WHEN w RLIKE '^commun' THEN 6 ELSE {_REGION.format('w')} END"),
    ("p2", f"p1 + {_REGION.format('substr(w, p1 + 1)')}"),
    (
        "w",
        "CASE WHEN w RLIKE 'sses$' THEN left(w, length(w) - 2) WHEN w RLIKE '(ied|ies)$' THEN left(w, length(w) - CASE WHEN length(w) > 4 THEN 2 ELSE 1 END) "
        "WHEN w RLIKE '(us|ss)$' THEN w WHEN w RLIKE '[aeiouy].+s$' THEN left(w, length(w) - 1) ELSE w END",
    ),
    ("done", f"w IN ({', '.join(repr(x) for x in FINISHED)})"),
    ("cut", "NOT done AND NOT w RLIKE '(eed|eedly)$' AND w RLIKE '[aeiouy].*(ed|edly|ing|ingly)$'"),
    (
        "w",
        "CASE WHEN done THEN w WHEN w RLIKE 'eed$' THEN CASE WHEN length(w) - 3 >= p1 THEN left(w, length(w) - 1) ELSE w END WHEN w RLIKE 'eedly$' THEN CASE WHEN length(w) - 5 >= p1 THEN left(w, length(w) - 3) ELSE w END "
        "WHEN cut THEN regexp_replace(w, '(ed|edly|ing|ingly)$', '') ELSE w END",
    ),
    (
        "w",
        f"CASE WHEN NOT cut THEN w WHEN w RLIKE '(at|bl|iz)$' THEN w || 'e' WHEN w RLIKE '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$' THEN left(w, length(w) - 1) WHEN p1 >= length(w) AND {_SHORT.format('w')} THEN w || 'e' ELSE w END",
    ),
    ("w", "CASE WHEN NOT done AND w RLIKE '.[^aeiouy][yY]$' THEN left(w, length(w) - 1) || 'i' ELSE w END"),
    ("w", f"CASE WHEN done THEN w ELSE {_endings(STEP_2, {'ogi': chr(119) + ' RLIKE ' + repr('logi$'), 'li': 'w RLIKE ' + repr('[cdeghkmnrt]li$')})} END"),
    ("w", f"CASE WHEN done THEN w ELSE {_endings(STEP_3, {})} END"),
    ("w", f"CASE WHEN done THEN w ELSE {_endings(dict.fromkeys(STEP_4, ''), {'ion': 'w RLIKE ' + repr('[st]ion$')}, 'p2')} END"),
    (
        "w",
        f"CASE WHEN done THEN w WHEN w RLIKE 'e$' THEN CASE WHEN length(w) - 1 >= p2 OR (length(w) - 1 >= p1 AND NOT {_SHORT.format('left(w, length(w) - 1)')}) THEN left(w, length(w) - 1) ELSE w END "
        "WHEN w RLIKE 'll$' AND length(w) - 1 >= p2 THEN left(w, length(w) - 1) ELSE w END",
    ),
    ("w", f"CASE {' '.join(f'WHEN word = {a!r} THEN {b!r}' for a, b in EXCEPTIONS.items())} WHEN length(word) <= 2 THEN word ELSE replace(w, 'Y', 'y') END"),
)


def stem(term: str) -> Column:
    """The stem of the lower-case words in the column ``term``.

    Every step is a function of the one before it, so that the plan doesn't repeat what a step refers to several times.
    """
    steps = "w"
    for column, expression in reversed(STEPS):
        steps = f"transform(array({expression}), {column} -> {steps})[0]"
    return F.expr(f"transform(array(`{term}`), word -> {steps})[0]")
