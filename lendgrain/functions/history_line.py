"""The same questions about a history held as one line of text, a character per slot.

A line has the bucket digit 0-7, u for -1, n for -2 and ? for unknown. Counting characters stays in
generated code, which an array lambda does not, so wide families use lines. All functions return
expression text.
"""

from pyspark.sql import functions as F

from lendgrain.functions.columns import as_col

DIGITS = "01234567"


def to_line(arr):
    return F.array_join(F.transform(as_col(arr), lambda x: F.when(x == -1, "u").when(x == -2, "n")
                                    .otherwise(F.coalesce(x.cast("string"), F.lit("?")))), "")


def _left(n, line="line"):
    return f"substr({line}, 1, {n})"


def _whole(n):
    return f"length(line) >= {n} and instr({_left(n)}, '?') = 0"


def count_ge(n, b):
    return f"case when {_whole(n)} then length(translate({_left(n)}, 'nu{DIGITS[:b]}', '')) end"


def count_eq(n, b):
    return f"case when {_whole(n)} then length(translate({_left(n)}, 'nu{DIGITS.replace(str(b), '')}', '')) end"


def any_ge(n, b):
    return f"case when length(translate({_left(n)}, '?nu{DIGITS[:b]}', '')) > 0 then 1 else 0 end"


def any_eq(n, b):
    return f"case when instr({_left(n)}, '{b}') > 0 then 1 else 0 end"


def worst(n):
    steps = " ".join(f"when instr({_left(n)}, '{c}') > 0 then {v}"
                     for c, v in [(d, int(d)) for d in reversed(DIGITS)] + [("u", -1), ("n", -2)])
    return f"case {steps} end"


def _mask(n, b):
    return f"translate({_left(n)}, '{DIGITS[b:]}', '{'h' * (8 - b)}')"


def first_pos(n, b):
    return f"nullif(instr({_mask(n, b)}, 'h'), 0)"


def last_pos(n, b):
    return f"case when instr({_mask(n, b)}, 'h') > 0 then length({_left(n)}) - instr(reverse({_mask(n, b)}), 'h') + 1 end"


def peak_pos(worst_col, n=36):
    c = f"case {worst_col} when -1 then 'u' when -2 then 'n' else cast({worst_col} as string) end"
    return f"nullif(instr({_left(n)}, {c}), 0)"


def satisfactory(n, written_off="written_off"):
    return (f"case when {written_off} = 1 then 0 when length({_left(n)}) = {n} and length(translate({_left(n)}, 'n01', '')) = 0 then 1 "
            f"when length(translate({_left(n)}, '?nu01', '')) > 0 then 0 end")


def recent_bad(n, b):
    """The newest reported slot is at b or above."""
    return f"case when substr(translate({_left(n)}, 'nu?', ''), 1, 1) >= '{b}' then 1 else 0 end"


def default_after(months_open, first=2, count=13):
    life = f"reverse(substr(line, 1, greatest({months_open}, 0)))"
    return f"length(translate(substr({life}, {first}, {count}), '?nu0', '')) > 0"
