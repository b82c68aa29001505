"""Find text that was read with a wrong character encoding, and restore it.

Each stretch of non-ASCII characters, with the ASCII characters next to it, starts a
best-first search. Its steps write a state back to bytes by one encoding and read the
bytes by any other (UTF-8 wherever valid sequences stand, the rest of the stretch
stays), or unescape character references. States seen before are skipped by hash. The cost
of a state says how implausible its characters are, one by one and side by side; each
step adds to the cost, and the cheapest reachable state wins: the search ends when no state
left could pay. A stretch that gets cheaper is garbled.

Stretches longer than ``PART`` are searched part by part; a chain found for one part is tried on the
whole stretch. A search that has visited ``MOST_STATES`` states is given up and counted as unfinished, never
taken for correct text in silence (:func:`unfinished_documents`).

Stretches recur, so a task searches each distinct one once and keeps the results in a
table of bounded size.
"""

from __future__ import annotations

import heapq
import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Encodings that texts are wrongly read by, and single-byte ones they were written in.
READ_AS = ("cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "iso8859-15", "iso8859-2", "koi8-r", "cp866", "cp1254", "cp852")
USUAL = ("cp1252", "cp1250", "cp1251", "koi8-r")
SINGLE = tuple((wrong, right) for wrong in READ_AS for right in READ_AS if wrong != right)

# Letters of the corpus's languages beyond ASCII, and usual signs in articles.
LETTERS = "äöüßÄÖÜẞéèêëàâùûîïôçœæÿÉÈÊËÀÂÙÛÎÏÔÇŒÆŸñáíóúÁÍÓÚÑãõÃÕąćęłńśźżĄĆĘŁŃŚŹŻåøÅØšžčřěŠŽČşŞğĞıİőűòìýÝﬀﬁﬂﬃﬄ"
SIGNS = "–—’‘“”„«»…§°±×÷µ·№€£¥©®™¶¬¿¡ªº²³¹⁰⁻⁺⁴⁵⁶⁷⁸⁹ⁿ†‡•‰′″≤≥≈≠√∞∂∆∇∑∏∫→←↔⇒∈∼   "

DRAWING = "─│┌┐└┘├┤┬┴┼"

STEP, REREAD = 1.0, 2.5  #: cost of a step that valid UTF-8 confirms, or of another one
RARE = 0.5  #: further cost of text written in other encodings than UTF-8 and the usual ones
ENTITY = 2.0  #: cost of a character reference
LEAST = 0.9  #: the lowest cost of a character
SEVERAL = 3  #: stretches of a text that a chain must mend before it is tried on the others
LOST = "\ufffd"
PART = 64  #: characters of a stretch that are searched together
MOST_STATES = 5_000  #: states visited from one start until the search counts as unfinished
REMEMBERED = 200_000  #: distinct stretches whose result a task keeps

_ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
_PLAIN_RUN = re.compile(r"[^\x00-\x7f]+")
_ENTITY_RUN = re.compile(rf"(?:[^\x00-\x7f]|{_ENTITY})+")
_UTF8 = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}")


@lru_cache(None)
def _bytes_of(encoding: str) -> dict[str, int]:
    """Character to byte; bytes an encoding leaves open are the C1 controls, as readers take them."""
    out = {}
    for b in range(128, 256):
        try:
            c = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            c = chr(b)
        out.setdefault(c, b)
    return out


@lru_cache(None)
def _char_of(encoding: str) -> dict[int, str]:
    return {b: c for c, b in _bytes_of(encoding).items()}


@lru_cache(65536)
def _kind(c: str) -> tuple[float, str, str]:
    """Cost of a character, its script (of letters) and its case or class."""
    if c < "\x80":
        return 0.0, "L" if c.isalpha() else "", "u" if c.isupper() else "l" if c.isalpha() else "d" if c.isdigit() else "s"
    if c in SIGNS:
        return 1.5, "", "t" if c in "–—’‘“”„«»…·   " else "p"
    category = unicodedata.category(c)
    if category[0] == "L":
        name = unicodedata.name(c, "")
        script = "L" if name.startswith("LATIN") else "C" if name.startswith("CYRILLIC") else "G" if name.startswith("GREEK") else "o"
        case = "u" if category == "Lu" else "l" if category == "Ll" else "o"
        if script == "L":
            return (1.0 if c in LETTERS else 2.5), script, case
        if script == "C":
            return (1.0 if "а" <= c <= "я" or "А" <= c <= "Я" or c in "ёЁ" else 2.5), script, case
        return (1.2 if script == "G" else 4.5), script, case
    if category in ("Mn", "Cf"):
        return 2.0, "", "m"
    if category in ("Cc", "Cn", "Co") or c == LOST:
        return 12.0, "", "c"
    if "─" <= c <= "▟":
        return 2.0, "", "b"
    return 2.5, "", "p"


def cost(before: str, run: str, after: str) -> float:
    """How implausible ``run`` is between the characters ``before`` and ``after`` ('' at an end)."""
    total = 0.0
    if "&" in run:  # a reference to a character beyond ASCII costs as much as the character and a step
        total += ENTITY * sum(not html.unescape(m).isascii() for m in re.findall(_ENTITY, run))
    chars = [*([before] if before else []), *run, *([after] if after else [])]
    kinds = [_kind(c) for c in chars]
    first = 1 if before else 0
    drawing = len(run) > 1 and all(c in DRAWING for c in run) and not (kinds[0][1] or kinds[-1][1])
    for k in range(first, first + len(run)):
        total += 0.9 if drawing else kinds[k][0]
    for k in range(1, len(chars)):
        (_, s1, c1), (_, s2, c2) = kinds[k - 1], kinds[k]
        if s1 and s2:
            if s1 != s2:
                total += 4
            elif c1 == "l" and c2 == "u":
                total += 3
            elif s1 == "L" and chars[k - 1] > "\x7f" and chars[k] > "\x7f":
                total += 0.7
        elif s1 and c2 in "pb":
            total += 2 if c2 == "p" else 4
        elif c1 in "pb" and s2:
            within = k > 1 and kinds[k - 2][1]  # a sign inside a word
            if chars[k - 1] not in "¿¡" or within:
                total += (3 if within else 1) if c1 == "p" else 4
    return total


def _spelled(run: str, encoding: str) -> str:
    """``run`` with every valid UTF-8 sequence that it spells by ``encoding`` read as UTF-8."""
    table = _bytes_of(encoding)
    try:
        raw = bytes([table[c] for c in run])
    except KeyError:  # some characters aren't of this encoding: they part the run
        if len(run) == 1:
            return run
        known = [c in table for c in run]
        cuts = [0, *(k for k in range(1, len(run)) if known[k] != known[k - 1]), len(run)]
        return "".join(_spelled(run[a:b], encoding) if known[a] else run[a:b] for a, b in zip(cuts, cuts[1:]))
    out, last = [], 0
    for m in _UTF8.finditer(raw):
        out += (run[last : m.start()], m.group().decode())
        last = m.end()
    return "".join(out) + run[last:] if out else run


def _reread(run: str, wrong: str, right: str) -> str:
    table, back = _bytes_of(wrong), _char_of(right)
    return "".join(back[table[c]] for c in run) if all(c in table for c in run) else run


def apply(run: str, path: tuple[str, ...]) -> str:
    """The state that the named steps lead to."""
    for name in path:
        wrong, _, right = name.partition(">")
        run = html.unescape(run) if name == "unescape" else _spelled(run, wrong) if right == "utf-8" else _reread(run, wrong, right)
    return run


def _price(right: str) -> float:
    return STEP if right == "utf-8" else REREAD if right in USUAL else REREAD + RARE


def steps(run: str, reread: bool) -> Iterator[tuple[str, str, float]]:
    """States one step away, each with the step's name and cost."""
    for encoding in READ_AS:
        new = _spelled(run, encoding)
        if new != run:
            yield f"{encoding}>utf-8", new, STEP
    if reread:
        for wrong, right in SINGLE:
            new = _reread(run, wrong, right)
            if new != run:
                yield f"{wrong}>{right}", new, _price(right)
    if "&" in run:
        new = html.unescape(run)
        if new != run:
            yield "unescape", new, STEP


def search(before: str, run: str, after: str) -> tuple[str, tuple[str, ...], float, bool]:
    """The cheapest state reachable from ``run``, the steps to it, what is gained by them, and whether the search came to its end.

    A step is left out where even characters of the lowest cost couldn't make it pay.
    """
    if len(run) > PART:
        return _search_parts(before, run, after)
    begun = cost(before, run, after)
    best, best_total, path = run, begun, ()
    queue = [(begun, 0, run, (), 0.0)]
    seen = {hash(run)}
    order = visited = 0
    while queue and visited < MOST_STATES:
        _, _, state, taken, spent = heapq.heappop(queue)
        size = len(html.unescape(state)) if "&" in state else len(state)
        if spent + STEP + LEAST * size / 4 >= best_total:
            continue
        visited += 1
        for name, new, price in steps(state, spent + REREAD + LEAST * size < best_total):
            if hash(new) in seen:
                continue
            seen.add(hash(new))
            own = cost(before, new, after) + spent + price
            order += 1
            heapq.heappush(queue, (own, order, new, (*taken, name), spent + price))
            if own < best_total:
                best, best_total, path = new, own, (*taken, name)
    return best, path, begun - best_total, visited < MOST_STATES


def _search_parts(before: str, run: str, after: str) -> tuple[str, tuple[str, ...], float, bool]:
    """A long stretch: the chain of one of its parts that makes the whole cheapest."""
    parts = [run[a : a + PART] for a in range(0, len(run), PART)]
    sides = [before, *(p[-1] for p in parts)], [*(p[0] for p in parts[1:]), after]
    found = [search(left, part, right) for left, part, right in zip(sides[0], parts, sides[1])]
    begun = cost(before, run, after)
    best, path, gain = run, (), 0.0
    for chain in dict.fromkeys(f[1] for f in found if f[1]):
        new = apply(run, chain)
        own = begun - cost(before, new, after) - sum(STEP if c == "unescape" else _price(c.partition(">")[2]) for c in chain)
        if own > gain:
            best, path, gain = new, chain, own
    return best, path, gain, all(f[3] for f in found)


class Searcher:
    """Searches with a bounded memory of results."""

    def __init__(self):
        self.known: dict[tuple[str, str, str], tuple[str, tuple[str, ...], float, bool]] = {}

    def __call__(self, before: str, run: str, after: str) -> tuple[str, tuple[str, ...], float, bool]:
        key = (_side(before), run, _side(after))
        if key not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[key] = search(*key)
        return self.known[key]


def _side(c: str) -> str:
    """What of a neighbouring ASCII character counts: a small letter, a capital or neither."""
    return "" if not c.isalpha() else "A" if c.isupper() else "a"


def stretches(text: str) -> Iterator[tuple[int, str, str, str]]:
    """Start of each stretch, the character before it, the stretch, the character after it."""
    if text.isascii() and "&" not in text:
        return
    pattern = _ENTITY_RUN if "&" in text else _PLAIN_RUN
    for m in pattern.finditer(text):
        a, b = m.span()
        yield a, text[a - 1 : a], m.group(), text[b : b + 1]


def is_garbled(text: str, searched: Searcher) -> bool:
    """Whether a stretch gets cheaper by some steps, or holds the sign of lost bytes."""
    return any(LOST in run or searched(before, run, after)[2] > 0 for _, before, run, after in stretches(text))


def unfinished(text: str, searched: Searcher) -> int:
    """How many stretches of a text have a search that was given up without a gain."""
    return sum(not (found := searched(before, run, after))[3] and found[2] <= 0 for _, before, run, after in stretches(text))


def restore(text: str, searched: Searcher) -> tuple[str, list[str], int]:
    """The text restored, the chains of steps used (most used first), and how many characters are lost.

    Texts garbled several times over are gone through again until nothing changes.
    """
    chains: Counter[str] = Counter()
    seen = {hash(text)}
    while True:
        text, used = _one_pass(text, searched)
        chains += used
        if hash(text) in seen:
            return text, [c for c, _ in chains.most_common()], text.count(LOST)
        seen.add(hash(text))


def _one_pass(text: str, searched: Searcher) -> tuple[str, Counter[str]]:
    """Each stretch in its cheapest state, and the chains used.

    A chain that lowers the cost of ``SEVERAL`` stretches of a text is also tried on its other
    stretches, where one is too short to tell by itself.
    """
    found = [(a, before, run, after, *searched(before, run, after)[:3]) for a, before, run, after in stretches(text)]
    used: Counter[tuple[str, ...]] = Counter()
    gains: Counter[tuple[str, ...]] = Counter()
    for *_, path, gain in found:
        if path:
            used[path] += 1
            gains[path] += gain
    usual = [p for p, _ in gains.most_common() if used[p] >= SEVERAL]
    out, last, chains = [], 0, Counter()
    for a, before, run, after, best, path, gain in found:
        before, after = _side(before), _side(after)
        least = cost(before, run, after) - gain
        for p in usual:
            new = apply(run, p) if p != path else run
            if new != run and cost(before, new, after) <= least:
                best, path, least = new, p, cost(before, new, after)
        if path:
            chains[" ".join(path)] += 1
        out += (text[last:a], best)
        last = a + len(run)
    return "".join(out) + text[last:], chains


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    searched = Searcher()
    for batch in batches:
        garbled = [t is not None and is_garbled(t, searched) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id").filter(pa.array(garbled, pa.bool_()))], ["id"])


def _restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    searched = Searcher()
    for batch in batches:
        rows = [(i, *restore(t, searched)) for i, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()) if t is not None and is_garbled(t, searched)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], batch.schema.field("id").type), pa.array([r[1] for r in rows], pa.string()),
                pa.array([r[2] for r in rows], pa.list_(pa.string())), pa.array([r[3] for r in rows], pa.int64()),
            ],
            ["id", "text", "chains", "lost"],
        )


def garbled_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` of each row whose text is garbled, in whole or in part.

    Null, empty and ASCII texts without character references never are; a repeated row
    comes out as often as it goes in; other columns are ignored; an empty table gives
    no rows. Nothing is shuffled.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_found, f"id {rows.schema['id'].dataType.simpleString()}").withColumnRenamed("id", id_col)


def restored_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each garbled row: ``id_col``, ``text`` restored as far as it can be, ``chains`` of steps, ``lost`` characters."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(_restored, f"id {rows.schema['id'].dataType.simpleString()}, text string, chains array<string>, lost long")
    return out.withColumnRenamed("id", id_col)


def _unfinished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    searched = Searcher()
    for batch in batches:
        left = pa.array([0 if t is None else unfinished(t, searched) for t in batch.column("text").to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("id"), left], ["id", "stretches"]).filter(pa.compute.greater(left, 0))


def unfinished_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``stretches`` of each row with stretches whose search was given up: whether these are garbled isn't known."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_unfinished, f"id {rows.schema['id'].dataType.simpleString()}, stretches long").withColumnRenamed("id", id_col)
