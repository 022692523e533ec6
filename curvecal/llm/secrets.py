"""Secret scan on DataFrame functions only.

Fixed patterns give the base spans. The method adds spans found by entropy: each run of
characters of a class (hexadecimal digits; base64 letters) is read once, a window of fixed
width slides over it, and the sum of c * log2(c) over the window's character counts is
changed by the character that enters and the one that leaves. Windows at or above the class's
threshold join to maximal spans; spans that an allow-list pattern matches are suppressed.

Positions are code points, ends exclusive. Null and empty texts have no spans. Rows are
independent; repeated rows give repeated results and other columns pass through.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed patterns: kind, pattern, group whose length counts, least length.
BASE = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),  # finds the same as one or more with 24 at least, without the short runs
]
# Character classes: kind, characters as a pattern, alphabet, bits that a window must have.
CLASSES = [
    ("entropy_hex", "[0-9a-fA-F]", "0123456789abcdefABCDEF", 3.0),
    ("entropy_base64", "[A-Za-z0-9+/_=-]", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.7),
]
# Spans that are no secrets: alphabets and counting sequences, placeholders, one case of letters only.
ALLOWED = [
    r"(?i)0123456789abcdef|abcdefghijklmnop|qwertyuiop",
    r"(?i)example|placeholder|changeme|x{8,}",
    r"^[a-z=_/+-]+$", r"^[A-Z=_/+-]+$", r"^[A-Z]?[a-z=_/+-]+$", r"^[0-9+/_=-]+$",
]
WINDOW = 20
RANK = {kind: i for i, kind in enumerate([b[0] for b in BASE] + [c[0] for c in CLASSES])}


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _matches(text: str, pattern: str, group: int) -> Column:
    """Leftmost matches as (start, end, text, length of the group).

    The texts between matches and the matches themselves alternate; their lengths give
    the positions. Nothing is built for a text without a match.
    """
    p = _quoted(pattern)
    counted = f"transform(regexp_extract_all({text}, {p}, {group}), x -> char_length(x))" if group else \
        f"transform(regexp_extract_all({text}, {p}, 0), x -> char_length(x))"
    return F.expr(f"""
        CASE WHEN {text} RLIKE {p} THEN aggregate(
            arrays_zip(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0), {counted}),
            named_struct('at', 0, 'found', CAST(array() AS array<struct<start:int,end:int,text:string,n:int>>)),
            (a, x) -> named_struct(
                'at', a.at + char_length(x['0']) + coalesce(char_length(x['1']), 0),
                'found', CASE WHEN x['1'] IS NULL THEN a.found ELSE array_append(a.found, named_struct(
                    'start', a.at + char_length(x['0']),
                    'end', a.at + char_length(x['0']) + char_length(x['1']),
                    'text', x['1'], 'n', x['2'])) END),
            a -> a.found)
        ELSE CAST(array() AS array<struct<start:int,end:int,text:string,n:int>>) END""")


def _entropy_spans(codes: str, size: int, bits: float, width: int) -> str:
    """SQL: maximal spans of high-entropy windows of a run, given as places in its alphabet.

    The state holds the counts of the window that ends before character i and the sum of
    c * log2(c) over them. Step i first judges that window, then takes in character i.
    """
    f = lambda c: f"(CASE WHEN {c} > 1 THEN {c} * log2({c}) ELSE 0.0D END)"
    new, old = f"{codes}[i - 1]", f"{codes}[i - 1 - {width}]"
    passes = f"i > {width} AND log2({width}) - s.sum / {width} >= {bits} - 1e-9"
    window = f"named_struct('start', i - 1 - {width}, 'end', i - 1)"
    return f"""
        aggregate(sequence(1, size({codes}) + 1),
            named_struct('counts', array_repeat(0, {size}), 'sum', 0.0D,
                         'high', CAST(array() AS array<struct<start:int,end:int>>)),
            (s, i) -> named_struct(
                'counts', CASE WHEN i > size({codes}) THEN s.counts ELSE transform(s.counts, (c, k) -> c
                    + CASE WHEN k = {new} THEN 1 ELSE 0 END
                    - CASE WHEN i > {width} AND k = {old} THEN 1 ELSE 0 END) END,
                'sum', CASE
                    WHEN i > size({codes}) OR i > {width} AND {new} = {old} THEN s.sum
                    ELSE s.sum + {f(f"(s.counts[{new}] + 1)")} - {f(f"s.counts[{new}]")}
                        + CASE WHEN i > {width} THEN {f(f"(s.counts[{old}] - 1)")} - {f(f"s.counts[{old}]")}
                          ELSE 0.0D END END,
                'high', CASE
                    WHEN NOT ({passes}) THEN s.high
                    WHEN size(s.high) > 0 AND s.high[size(s.high) - 1].end >= i - 1 - {width}
                        THEN concat(slice(s.high, 1, size(s.high) - 1),
                            array(named_struct('start', s.high[size(s.high) - 1].start, 'end', i - 1)))
                    ELSE array_append(s.high, {window}) END),
            s -> s.high)"""


SPAN = "struct<kind:string,start:int,end:int,text:string>"


def find_secrets(df: DataFrame, text: str = "text", width: int = WINDOW, out: str = "spans") -> DataFrame:
    """Add an array of spans (kind, start, end, text), ordered by start and kind."""
    kept = [F.col(f"`{c}`") for c in df.columns if c != out]
    rows = df.select(*kept, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_text"))
    found = {kind: _matches("_text", pattern, group) for kind, pattern, group, _ in BASE}
    runs = {kind: _matches("_text", f"{chars}{{{width},}}", 0) for kind, chars, _, _ in CLASSES}
    rows = rows.withColumns({f"_{k}": c for k, c in (found | runs).items()})
    parts = []
    for kind, _, group, least in BASE:
        parts.append(F.expr(f"""
            transform(filter(_{kind}, m -> {"m.n" if group else "char_length(m.text)"} >= {least}),
                m -> CAST(named_struct('kind', '{kind}', 'start', m.start, 'end', m.end, 'text', m.text) AS {SPAN}))"""))
    allowed = " OR ".join(f"h.text RLIKE {_quoted(p)}" for p in ALLOWED)
    for kind, _, alphabet, bits in CLASSES:
        coded = f"transform(split(m.text, ''), ch -> locate(ch, {_quoted(alphabet)}) - 1)"
        spans = _entropy_spans("codes", len(alphabet), bits, width)
        parts.append(F.expr(f"""
            filter(flatten(transform(_{kind}, m -> transform(
                flatten(transform(array({coded}), codes -> {spans})),
                h -> CAST(named_struct('kind', '{kind}', 'start', m.start + h.start, 'end', m.start + h.end,
                    'text', substring(m.text, h.start + 1, h.end - h.start)) AS {SPAN})))), h -> NOT ({allowed}))"""))
    rank = "CASE x.kind " + " ".join(f"WHEN '{k}' THEN {i}" for k, i in RANK.items()) + " END"
    rows = rows.withColumn("_all", F.concat(*parts))
    ordered = F.expr(f"""transform(
        array_sort(transform(_all, x -> named_struct('start', x.start, 'rank', {rank}, 'end', x.end, 'x', x))), y -> y.x)""")
    return rows.select(*kept, F.when(F.size("_all") > 0, ordered).otherwise(F.expr(f"CAST(array() AS array<{SPAN}>)")).alias(out))


def redact(df: DataFrame, text: str = "text", spans: str = "spans", mark: str = "[secret]") -> DataFrame:
    """Replace every span, or union of spans that overlap, by a mark."""
    t = f"coalesce(CAST(`{text}` AS string), '')"
    cut = F.expr(f"""
        aggregate(`{spans}`, named_struct('at', 0, 'out', ''),
            (a, x) -> CASE
                WHEN x.end <= a.at THEN a
                WHEN x.start < a.at THEN named_struct('at', x.end, 'out', a.out)
                ELSE named_struct('at', x.end,
                    'out', concat(a.out, substring({t}, a.at + 1, x.start - a.at), {_quoted(mark)})) END,
            a -> concat(a.out, substring({t}, a.at + 1)))""")
    return df.withColumn(text, F.when(F.size(spans) > 0, cut).otherwise(F.col(f"`{text}`")))
