"""Greedy chunk rules as SQL expressions: one fold over the token counts of a text's units, its state carried along, decides where chunks begin and end.

Units are sentences, pieces between separators or rows of a table. The fold holds a run of units; it keeps numbers of units only, the texts
are put together from slices afterwards. White space is Python's, which has more characters than \\s. Every function takes and gives SQL text, for `expr`.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

# White space of Python's str.split and str.strip; where sentences end; separators in the order in which they are tried.
WHITE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: What \s of the JVM leaves out.
RARE = WHITE.lstrip(" \t\n\x0b\x0c\r")
SENTENCE_END = rf"(?<=[.!?])[{WHITE}]+(?=[A-Z\"])|(?<=\n)[{WHITE}]*\n"
SEPARATORS = ["\n\n", "\n", " "]

#: How a unit is taken: after the units held, if they have room; alone; as the first of a new run; or after a break.
JOIN, ALONE, FIRST, BREAK = range(4)

#: Terms that two sentences share, up to which each is counted in both by a pass of its own.
FEW_TERMS = 8

_RUN = "array<struct<lo:int,hi:int,alone:boolean>>"
_number = count()


def name() -> str:
    """A new name for a lambda's variable."""
    return f"v{next(_number)}"


def raw(text: str) -> str:
    return f"r'{text}'"


def let(value: str, use: Callable[[str], str]) -> str:
    """`use` of a value that is computed once."""
    return f"get({each(f'array({value})', use)}, 0)"


def each(array: str, use: Callable[[str], str]) -> str:
    x = name()
    return f"transform({array}, {x} -> {use(x)})"


def each_at(array: str, use: Callable[[str, str], str]) -> str:
    x, i = name(), name()
    return f"transform({array}, ({x}, {i}) -> {use(x, i)})"


def those(array: str, condition: Callable[[str], str]) -> str:
    x = name()
    return f"filter({array}, {x} -> {condition(x)})"


def strip(text: str) -> str:
    return f"btrim({text}, {raw(WHITE)})"


def either(text: str, build: Callable[[bool], str]) -> str:
    """`build` for texts that may hold RARE white space, or for those that don't, which are counted in a third of the time."""
    return f"if({has_rare(text)}, {build(True)}, {build(False)})"


def has_rare(text: str) -> str:
    """False only if none of RARE is in the text; some other characters that begin with the same bytes of UTF-8 count, too."""
    starts = dict.fromkeys(c.encode()[:2] for c in RARE)
    within = " OR ".join(f"contains(CAST({text} AS BINARY), X'{s.hex()}')" for s in starts if len(s) > 1)
    return f"({' OR '.join(f'contains({text}, {raw(c)})' for c in RARE if c.isascii())} OR (octet_length({text}) > length({text}) AND ({within})))"


def n_tokens(text: str, rare: bool = True) -> str:
    """1.3 a word, half to even, at least 1; 0 for an empty text. rare: whether RARE white space may be in it."""
    plain = f"translate({text}, {raw(RARE)}, '{' ' * len(RARE)}')" if rare else text
    for c in WHITE:
        if c not in RARE + " ":
            plain = f"replace({plain}, {raw(c)}, ' ')"  # patterns with white space are many times slower
    return f"if({text} = '', 0, greatest(1, CAST(bround(size(array_remove(split({plain}, ' '), '')) * 1.3D) AS INT)))"


def unit(text: str, n: str, kind: str) -> str:
    return f"named_struct('t', {text}, 'n', {n}, 'kind', {kind})"


def packed(units: str, size: str, overlap: int) -> str:
    """Runs of units (n, kind) as lo, hi (the first after it), alone: greedy up to `size` tokens, each run after a full one begins with the last whole units of up to `overlap` tokens."""
    a, x, b, y, end = (name() for _ in range(5))
    run = lambda lo, hi, alone: f"array(named_struct('lo', {lo}, 'hi', {hi}, 'alone', {alone}))"
    held = f"{a}.lo < {a}.i"
    full = f"({x}.kind IN ({JOIN}, {BREAK}) AND {held} AND ({x}.kind = {BREAK} OR {a}.total + {x}.n > {size}))"
    near = f"greatest({a}.lo, {a}.i - {overlap})"  # a unit has one token at least
    tail = f"aggregate(reverse(slice({units}, {near} + 1, {a}.i - {near})), named_struct('c', 0, 's', 0, 'open', true), ({b}, {y}) -> if({b}.open AND {b}.s + {y}.n <= {overlap}, named_struct('c', {b}.c + 1, 's', {b}.s + {y}.n, 'open', true), named_struct('c', {b}.c, 's', {b}.s, 'open', false)))"
    over = lambda part: f"{tail}.{part}" if overlap else "0"
    lo = f"CASE WHEN {x}.kind = {ALONE} THEN {a}.i + 1 WHEN {x}.kind = {FIRST} THEN {a}.i WHEN {full} THEN {a}.i - {over('c')} ELSE {a}.lo END"
    total = f"CASE WHEN {x}.kind = {ALONE} THEN 0 WHEN {x}.kind = {FIRST} THEN {x}.n WHEN {full} THEN {over('s')} + {x}.n ELSE {a}.total + {x}.n END"
    last = f"if({held}, {run(f'{a}.lo', f'{a}.i', 'false')}, CAST(array() AS {_RUN}))"
    out = f"CASE WHEN {x}.kind = {ALONE} THEN concat({a}.out, {last}, {run(f'{a}.i', f'{a}.i + 1', 'true')}) WHEN {held} AND ({x}.kind = {FIRST} OR {full}) THEN concat({a}.out, {run(f'{a}.lo', f'{a}.i', 'false')}) ELSE {a}.out END"
    start = f"named_struct('i', 0, 'lo', 0, 'total', 0, 'out', CAST(array() AS {_RUN}))"
    return f"aggregate({units}, {start}, ({a}, {x}) -> named_struct('i', {a}.i + 1, 'lo', {lo}, 'total', {total}, 'out', {out}), {end} -> if({end}.lo < {end}.i, concat({end}.out, {run(f'{end}.lo', f'{end}.i', 'false')}), {end}.out))"


def joined(units: str, run: str, sep: str) -> str:
    return f"array_join({each(f'slice({units}, {run}.lo + 1, {run}.hi - {run}.lo)', lambda u: f'{u}.t')}, {raw(sep)})"


def runs(units: str, size: int, overlap: int, sep: str = " ") -> str:
    return let(units, lambda us: each(packed(us, str(size), overlap), lambda r: joined(us, r, sep)))


def sentences(text: str) -> str:
    return those(each(f"split({text}, {raw(SENTENCE_END)})", strip), lambda s: f"{s} <> ''")


def sentence_chunks(text: str, size: int, overlap: int, rare: bool = True) -> str:
    """Whole sentences; one that is too long is cut into windows of words, the last of which goes on as a sentence."""
    width = int(size / 1.3)
    part = lambda w, j: let(f"array_join(slice({w}, {j} * {width} + 1, {width}), ' ')", lambda t: unit(t, n_tokens(t, rare), f"if(({j} + 1) * {width} < size({w}), {ALONE}, {FIRST})"))
    words = lambda s: those(f"split({s}, {raw(f'[{WHITE}]+')})", lambda w: f"{w} <> ''")
    windows = lambda s: let(words(s), lambda w: each(f"sequence(0, (size({w}) - 1) DIV {width})", lambda j: part(w, f"CAST({j} AS INT)")))
    counted = each(sentences(text), lambda s: unit(s, n_tokens(s, rare), str(JOIN)))
    return runs(f"flatten({each(counted, lambda u: f'if({u}.n > {size}, {windows(f"{u}.t")}, array({u}))')})", size, overlap)


def windows(text: str, size: int, overlap: int) -> str:
    """The runs that `packed` makes of words of one token each, a text's pieces between spaces where it has no other white space: every one but the last has `size` words."""
    step = size - overlap
    part = lambda w, k: f"named_struct('t', array_join(slice({w}, CAST({k} AS INT) * {step} + 1, {size}), ' '), 'open', false)"
    return let(f"array_remove(split({text}, ' '), '')", lambda w: each(f"sequence(0, (greatest(size({w}) - {size}, 0) + {step - 1}) DIV {step})", lambda k: part(w, k)))


def recursive_chunks(text: str, size: int, overlap: int, rare: bool = True) -> str:
    """Pieces between blank lines; those too long between line ends; those too long between spaces; what is still too long is cut by characters."""

    def level(t: str, sep: str) -> str:
        parts = f"array_remove(split({t}, {raw(sep)}), '')"
        units = each(parts, lambda s: let(n_tokens(s, rare), lambda n: unit(s, n, f"if({n} > {size}, {ALONE}, {JOIN})")))
        folded = let(units, lambda us: each(packed(us, str(size), overlap), lambda r: f"named_struct('t', {joined(us, r, sep)}, 'open', {r}.alone)"))
        if rare or sep != " " or overlap >= size:
            return folded
        other = " OR ".join(f"contains({t}, {raw(c)})" for c in WHITE if c not in RARE + " ")
        return f"if({other}, {folded}, {windows(t, size, overlap)})"

    found = level(text, SEPARATORS[0])
    for sep in SEPARATORS[1:]:
        deeper = lambda p, sep=sep: f"if({p}.open, {level(f'{p}.t', sep)}, array({p}))"
        found = f"flatten({each(found, deeper)})"
    cut = lambda t: each(f"sequence(0, (length({t}) - 1) DIV {4 * size})", lambda j: f"substring({t}, CAST({j} AS INT) * {4 * size} + 1, {4 * size})")
    out = f"flatten({each(found, lambda p: f'if({p}.open, {cut(f"{p}.t")}, array({p}.t))')})"
    return f"CASE WHEN {n_tokens(text, rare)} > {size} THEN {out} WHEN {strip(text)} <> '' THEN array({text}) ELSE CAST(array() AS array<string>) END"


def firsts(sorted_: str, key: Callable[[str], str]) -> str:
    """Places in a sorted array where a new key begins."""
    return those(each_at(sorted_, lambda x, i: f"if({i} = 0 OR {key(f'get({sorted_}, {i} - 1)')} <> {key(x)}, {i}, NULL)"), lambda i: f"{i} IS NOT NULL")


def bag(sentence: str) -> str:
    """Its runs of [a-z0-9] in lower case."""
    return f"array_remove(split(lower({sentence}), '[^a-z0-9]+'), '')"


def norm(words: str) -> str:
    """Sum of the squared counts of an array's words: of its size if none is repeated, else by a fold over the sorted words."""
    a, x, end = name(), name(), name()
    step = f"if({x} = {a}.t, named_struct('t', {x}, 'n', {a}.n + 1L, 's', {a}.s + 2L * {a}.n + 1L), named_struct('t', {x}, 'n', 1L, 's', {a}.s + 1L))"
    folded = f"aggregate(sort_array({words}), named_struct('t', '', 'n', 0L, 's', 0L), ({a}, {x}) -> {step}, {end} -> {end}.s)"
    return f"if(size(array_distinct({words})) = size({words}), CAST(size({words}) AS BIGINT), {folded})"


def total(values: str) -> str:
    a, x = name(), name()
    return f"aggregate({values}, 0L, ({a}, {x}) -> {a} + {x})"


def similarities(parts: str) -> str:
    """Cosine of the word counts of each sentence and the one before, from the second on."""
    measured = each(parts, lambda p: let(bag(p), lambda w: f"named_struct('w', {w}, 'norm', {norm(w)})"))
    times = lambda w, t: f"CAST(size({w}) - size(array_remove({w}, {t})) AS BIGINT)"
    few = lambda a, b, both: total(each(both, lambda t: f"{times(f'{a}.w', t)} * {times(f'{b}.w', t)}"))
    many = lambda a, b: let(f"concat({a}.w, {b}.w)", lambda w: f"({norm(w)} - {a}.norm - {b}.norm) DIV 2")
    dot = lambda a, b: let(f"array_intersect({a}.w, {b}.w)", lambda both: f"if(size({both}) <= {FEW_TERMS}, {few(a, b, both)}, {many(a, b)})")
    cosine = lambda a, b: f"if({a}.norm > 0 AND {b}.norm > 0, {dot(a, b)} / sqrt(CAST({a}.norm * {b}.norm AS DOUBLE)), 0D)"
    return let(measured, lambda m: each_at(f"slice({m}, 2, greatest(size({m}) - 1, 0))", lambda b, i: let(f"get({m}, {i})", lambda a: cosine(a, b))))


def threshold(sims: str, percentile: int) -> str:
    """The similarity below which a chunk ends: that of the lowest 100 - percentile per cent."""
    return f"coalesce(get(array_sort({sims}), greatest(0, CAST(floor(size({sims}) * {100 - percentile} / 100D) AS INT) - 1)), 0.3D)"


def semantic_chunks(text: str, size: int, overlap: int, percentile: int, rare: bool = True) -> str:
    """Whole sentences; a run ends where sentences are unlike, too."""
    kind = lambda i, sims, cut: f"if({i} > 0 AND get({sims}, {i} - 1) < {cut}, {BREAK}, {JOIN})"
    units = lambda ss, sims, cut: each_at(ss, lambda s, i: unit(s, n_tokens(s, rare), kind(i, sims, cut)))
    return runs(let(sentences(text), lambda ss: let(similarities(ss), lambda sims: let(threshold(sims, percentile), lambda cut: units(ss, sims, cut)))), size, overlap)


def tables(text: str) -> str:
    """Runs of lines like |...|: first_line, n_lines, text, has_separator."""
    a, x, end = name(), name(), name()
    row = f"{x} RLIKE r'^\\|.+\\|$'"
    out = f"if(NOT {row} AND {a}.lo >= 0, concat({a}.out, array(named_struct('lo', {a}.lo, 'hi', {a}.i))), {a}.out)"
    step = f"named_struct('i', {a}.i + 1, 'lo', CASE WHEN NOT {row} THEN -1 WHEN {a}.lo >= 0 THEN {a}.lo ELSE {a}.i END, 'out', {out})"
    found = lambda ls: f"aggregate(concat({ls}, array('')), named_struct('i', 0, 'lo', -1, 'out', CAST(array() AS array<struct<lo:int,hi:int>>)), ({a}, {x}) -> {step}, {end} -> {end}.out)"
    sep = lambda ls, r: f"coalesce({r}.hi - {r}.lo > 1 AND get({ls}, {r}.lo + 1) RLIKE r'^\\|[\\s:|-]+\\|$', false)"
    block = lambda ls, r: f"named_struct('first_line', {r}.lo, 'n_lines', {r}.hi - {r}.lo, 'text', array_join(slice({ls}, {r}.lo + 1, {r}.hi - {r}.lo), '\\n'), 'has_separator', {sep(ls, r)})"
    some = let(each(f"split({text}, '\\n')", lambda s: f"trim({s})"), lambda ls: each(found(ls), lambda r: block(ls, r)))
    return f"if(contains({text}, '|'), {some}, CAST(array() AS array<struct<first_line:int,n_lines:int,text:string,has_separator:boolean>>))"


def table_parts(table: str, limit: int) -> str:
    """row_start, row_end, text of a table (text, has_separator): whole up to `limit` tokens, else batches of rows below the header."""
    part = lambda a, b, t: f"named_struct('row_start', {a}, 'row_end', {b}, 'text', {t})"
    n_head = f"if({table}.has_separator, 2, 1)"
    text = lambda head, body, r: f"array_join(concat({head}, slice({body}, {r}.lo + 1, {r}.hi - {r}.lo)), '\\n')"
    batches = lambda head, body, room, us: each(packed(us, room, 0), lambda r: part(f"{r}.lo", f"{r}.hi - 1", text(head, body, r)))
    cut = lambda head, body: let(f"{limit} - {n_tokens(f"array_join({head}, '\\n')")}", lambda room: let(each(body, lambda r: unit(r, n_tokens(r), str(JOIN))), lambda us: batches(head, body, room, us)))
    whole = lambda body: f"array({part('0', f'greatest(size({body}) - 1, 0)', f'{table}.text')})"
    either = lambda head, body: f"if({n_tokens(f'{table}.text')} <= {limit} OR size({body}) = 0, {whole(body)}, {cut(head, body)})"
    return let(f"split({table}.text, '\\n')", lambda rows: let(f"slice({rows}, 1, {n_head})", lambda head: let(f"slice({rows}, {n_head} + 1, size({rows}))", lambda body: either(head, body))))


def first_of_each(rows: str, key: Callable[[str], str]) -> str:
    """The array without the elements whose key came before, in order."""
    keyed = each_at(rows, lambda x, i: f"named_struct('key', {key(x)}, 'i', {i})")
    kept = let(f"array_sort({keyed})", lambda s: f"array_sort({each(firsts(s, lambda x: f'{x}.key'), lambda i: f'get({s}, {i}).i')})")
    return each(kept, lambda i: f"get({rows}, {i})")
