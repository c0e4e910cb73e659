"""Periodic runs of words: found once in a grammar, then carried to every place.

The texts of a piece of input become one sequence of word numbers.  Re-Pair
replaces pairs that repeat by new symbols, so a stretch that stands often is one
symbol with one rule.  A run has a lowest symbol that holds it whole and crosses
the boundary between the two parts of that symbol's rule, or one between two
symbols that are left at the end.  So it is enough to look at each boundary once:

1. Half of a run lies on one side of the boundary, hence some words beside the
   boundary stand again one period further.  Grams of 4, 8, 16... words, each for
   the periods up to four times its length, give the candidate periods.
2. A period's stretch reaches as far as the words one period apart agree: binary
   search over prefix hashes, verified word by word.
3. Stretches found in a rule are moved to all places that the rule derives.
   There they may be parts of longer ones: those of one period that overlap by a
   period or more are one run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from evalsweep.llm.common import U64, PolyHash, map_batches, mixed, texts

#: order(doc_id, n) gives, for each of n places, which word of the text stands there; None for as written.
Order = Callable[[int | None, int], np.ndarray | None]


@dataclass
class Grammar:
    """Binary rules over symbols; those below ``len(left)`` without parts are words.

    ``first`` is a place where the symbol's expansion stands, ``size`` its length;
    ``rounds`` the first symbol of each round, so that parts come before wholes.
    """

    left: np.ndarray
    right: np.ndarray
    size: np.ndarray
    first: np.ndarray
    rounds: list[int]
    top_at: np.ndarray  # places where the symbols that are left begin
    top: np.ndarray


def re_pair(words: np.ndarray, starts: np.ndarray, n_words: int) -> Grammar:
    """Replace repeated pairs of neighbours until none repeats; pairs never cross texts.

    Each round counts the pairs and replaces, of pairs that overlap, the more
    frequent one (by powers of two, then by a hash): the most frequent pair is
    replaced wherever it stands, others where no better one is in the way.
    """
    n = len(words)
    symbol = words.astype(np.int64)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    after[starts[1:] - 1] = n  # the last word of a text has none after it
    before[starts[:-1]] = -1
    gone = np.zeros(n + 1, bool)
    gone[n] = True
    left, right = np.full(n_words, -1), np.full(n_words, -1)
    size, first = np.ones(n_words, np.int64), np.full(n_words, -1)
    known, known_symbol = np.zeros(0, np.int64), np.zeros(0, np.int64)
    rounds = []
    at = np.flatnonzero(after < n)  # places whose pair may repeat, ascending
    while len(at):
        pairs = symbol[at] << 32 | symbol[after[at]]
        kinds, kind, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        again = counts[kind] > 1
        at, pairs, kind = at[again], pairs[again], kind[again]
        if not len(at):
            break
        level = np.log2(counts).astype(U64) << U64(58)
        rank = (level | mixed(kinds.view(U64)) >> U64(6))[kind]
        # Overlapping pairs of one kind (a a a) form a stretch; the stretch has to win as a whole.
        joined = after[at[:-1]] == at[1:]
        fresh = np.r_[True, ~(joined & (rank[1:] == rank[:-1]))]
        heads = np.flatnonzero(fresh)
        tails = np.r_[heads[1:], len(at)] - 1
        beats_before = np.ones(len(heads), bool)
        beats_before[1:] = ~joined[heads[1:] - 1] | (rank[heads[1:] - 1] < rank[heads[1:]])
        beats_after = np.ones(len(heads), bool)
        beats_after[:-1] = ~joined[tails[:-1]] | (rank[tails[:-1] + 1] < rank[tails[:-1]])
        which = np.cumsum(fresh) - 1
        offset = np.arange(len(at)) - heads[which]
        chosen = (beats_before & beats_after)[which] & (offset % 2 == 0)
        place, pair = at[chosen], pairs[chosen]
        new, one, own = np.unique(pair, return_index=True, return_inverse=True)
        found = np.searchsorted(known, new)
        old = np.zeros(len(new), bool)
        inside = found < len(known)
        old[inside] = known[found[inside]] == new[inside]
        number = np.empty(len(new), np.int64)
        number[old] = known_symbol[found[old]]
        made = np.flatnonzero(~old)
        number[made] = len(size) + np.arange(len(made))
        rounds.append(len(size))
        parts = new[made] >> 32, new[made] & 0xFFFFFFFF
        left, right = np.r_[left, parts[0]], np.r_[right, parts[1]]
        size, first = np.r_[size, size[parts[0]] + size[parts[1]]], np.r_[first, place[one[made]]]
        known, known_symbol = np.r_[known, new[made]], np.r_[known_symbol, number[made]]
        order = np.argsort(known)
        known, known_symbol = known[order], known_symbol[order]
        symbol[place] = number[own]
        eaten = after[place]
        gone[eaten] = True
        after[place] = after[eaten]
        inner = place[after[place] < n]
        before[after[inner]] = inner
        at = np.concatenate([at[~chosen], place, before[place]])
        at = np.unique(at[at >= 0])
        at = at[~gone[at] & (after[at] < n)]
    top_at = np.flatnonzero(~gone[:n])
    return Grammar(left, right, size, first, rounds, top_at, symbol[top_at])


def _extend(poly: PolyHash, a: np.ndarray, b: np.ndarray, most: np.ndarray, ahead: bool) -> np.ndarray:
    """Words that agree from a and b on, or before them, at most ``most``; by binary search."""
    low, high = np.zeros(len(a), np.int64), np.maximum(most, 0)
    for _ in range(int(high.max(initial=0)).bit_length()):
        middle = (low + high + 1) >> 1
        if ahead:
            same = poly.of(a, a + middle) == poly.of(b, b + middle)
        else:
            same = poly.of(a - middle, a) == poly.of(b - middle, b)
        low, high = np.where(same, middle, low), np.where(same, high, np.maximum(middle - 1, low))
    return low


def _candidates(
    keys: np.ndarray, at: np.ndarray, x: np.ndarray, least: np.ndarray, most: np.ndarray, ahead: bool
) -> tuple[np.ndarray, np.ndarray]:
    """(which of x, distance) for places with the same gram as x at least and at most so far off.

    ``keys`` and ``at`` are grams and their places, sorted by both.
    """
    fresh = np.r_[True, keys[1:] != keys[:-1]]
    group = np.cumsum(fresh) - 1
    width = int(at.max(initial=0)) + 2
    line = group * width + at
    by_place = np.argsort(at, kind="stable")
    found = np.searchsorted(at, x, sorter=by_place)
    found = by_place[np.minimum(found, len(at) - 1)]
    row = np.flatnonzero(at[found] == x)
    base = group[found[row]] * width
    if ahead:
        lo, hi = x[row] + least[row], np.minimum(x[row] + most[row], width - 1)
    else:
        lo, hi = np.maximum(x[row] - most[row], 0), x[row] - least[row]
    lo, hi = base + lo, base + hi
    start, stop = np.searchsorted(line, lo), np.searchsorted(line, hi, "right")
    n = np.where(hi >= lo, np.maximum(stop - start, 0), 0)
    which = np.repeat(np.arange(len(row)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + start[which]
    return row[which], np.abs(at[place] - x[row[which]])


def crossing(
    words: np.ndarray, ends: np.ndarray, lo: np.ndarray, mid: np.ndarray, hi: np.ndarray, least: int, times: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Periodic stretches within [lo, hi) across each boundary ``mid``: boundary, start, end, period.

    ``ends`` holds for each word the end of its text.  A stretch has ``least``
    words and ``times`` periods at least and is as long as [lo, hi) allows.
    """
    if (times, least) < (3, 24):
        raise ValueError("the grams beside a boundary are enough for three periods and 24 words")
    n = len(words)
    poly = PolyHash(11)
    poly.values = mixed(np.arange(int(words.max(initial=0)) + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(99))
    poly.load(words)
    text = mixed(ends.astype(U64))
    at = np.arange(n)
    none = np.zeros(0, np.int64)
    held: list[tuple] = []
    # Boundaries inside a stretch of smaller period: its multiples need no look.
    reach_lo, reach_hi = mid.copy(), mid.copy()
    gram = 4
    while len(at) and len(mid):
        at = at[at + gram <= ends[at]]
        if not len(at):
            break
        keys = mixed(poly.of(at, at + gram) ^ text[at])
        order = np.argsort(keys, kind="stable")
        keys, at = keys[order], at[order]
        same = keys[1:] == keys[:-1]
        twice = np.r_[same, False] | np.r_[False, same]
        keys, at = keys[twice], at[twice]
        if not len(at):
            break
        smallest, largest = (1 if gram == 4 else 2 * gram + 1), 4 * gram
        many = np.full(len(mid), largest)
        found = []
        for ahead in (True, False):
            x = mid if ahead else mid - gram
            inside = reach_hi >= mid + gram if ahead else reach_lo <= mid - gram
            past = reach_hi - gram + 1 - x if ahead else x - (reach_lo - 1)
            first = np.maximum(smallest, np.where(inside, past, 0))
            row, q = _candidates(keys, at, x, first, many, ahead)
            found.append((row, q, mid[row] if ahead else mid[row] - q))
        row, q, u = (np.concatenate(c) for c in zip(*found))
        good = (u >= lo[row]) & (u + q <= hi[row]) & (times * q <= hi[row] - lo[row])
        row, q, u = row[good], q[good], u[good]
        right = _extend(poly, u, u + q, hi[row] - u - q, True)
        back = _extend(poly, u, u + q, u - lo[row], False)
        s, e = u - back, u + q + right
        long = e - s >= np.maximum(least, times * q)
        row, q, s, e = row[long], q[long], s[long], e[long]
        row, q, s, e = _verified(words, lo, hi, row, q, s, e, least, times)
        held.append((row, s, e, q))
        at = np.sort(at)
        gram *= 2
        # Of those stretches, the ones whose period fits into the next gram.
        fits = q <= gram
        np.minimum.at(reach_lo, row[fits], s[fits])
        np.maximum.at(reach_hi, row[fits], e[fits])
    if not held:
        return none, none, none, none
    row, s, e, q = (np.concatenate(c) for c in zip(*held))
    # A stretch of several periods is one of the smallest.
    order = np.lexsort((q, e, s, row))
    row, s, e, q = row[order], s[order], e[order], q[order]
    kept = np.r_[True, (row[1:] != row[:-1]) | (s[1:] != s[:-1]) | (e[1:] != e[:-1])][: len(row)]
    return row[kept], s[kept], e[kept], q[kept]


def _verified(words, lo, hi, row, q, s, e, least, times):
    """Compare the words themselves; where hashes collided, measure again without them."""
    spans, own = np.unique(np.stack([s, e, q], 1), axis=0, return_inverse=True)
    good = np.ones(len(spans), bool)
    for i, (a, b, p) in enumerate(spans.tolist()):
        good[i] = (words[a : b - p] == words[a + p : b]).all()
    if good.all():
        return row, q, s, e
    s, e, keep = s.copy(), e.copy(), np.ones(len(row), bool)
    for i in np.flatnonzero(~good[own.ravel()]):
        a, b, p = int(s[i]), int(e[i]), int(q[i])
        agree = words[lo[row[i]] : hi[row[i]] - p] == words[lo[row[i]] + p : hi[row[i]]]
        padded = np.r_[False, agree, False].astype(np.int8)
        begin, end = np.flatnonzero(np.diff(padded) == 1), np.flatnonzero(np.diff(padded) == -1)
        # The longest agreement within what the hashes took for one.
        inside = (begin + lo[row[i]] >= a) & (end + lo[row[i]] + p <= b)
        if not inside.any():
            keep[i] = False
            continue
        best = np.flatnonzero(inside)[np.argmax((end - begin)[inside])]
        s[i], e[i] = begin[best] + lo[row[i]], end[best] + lo[row[i]] + p
        keep[i] = e[i] - s[i] >= max(least, times * p)
    return row[keep], q[keep], s[keep], e[keep]


def _derived(grammar: Grammar, rule: np.ndarray, s: np.ndarray, e: np.ndarray, q: np.ndarray) -> tuple:
    """Stretches of rules, counted from where the rule begins, at all places that the rule derives."""
    n = len(grammar.size)
    order = np.argsort(rule, kind="stable")
    rule, s, e, q = rule[order], s[order], e[order], q[order]
    own_from, own_to = np.searchsorted(rule, np.arange(n)), np.searchsorted(rule, np.arange(n), "right")
    carries = own_to > own_from
    for a, b in zip(grammar.rounds, [*grammar.rounds[1:], n]):
        carries[a:b] |= carries[grammar.left[a:b]] | carries[grammar.right[a:b]]
    at, symbol = grammar.top_at, grammar.top
    out = []
    while True:
        live = carries[symbol]
        at, symbol = at[live], symbol[live]
        if not len(at):
            break
        counts = own_to[symbol] - own_from[symbol]
        which = np.repeat(np.arange(len(at)), counts)
        one = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + own_from[symbol][which]
        out.append((at[which] + s[one], at[which] + e[one], q[one]))
        inner = grammar.left[symbol] >= 0
        at, symbol = at[inner], symbol[inner]
        part = grammar.left[symbol]
        at, symbol = np.r_[at, at + grammar.size[part]], np.r_[part, grammar.right[symbol]]
    if not out:
        return s[:0], e[:0], q[:0]
    return tuple(np.concatenate(c) for c in zip(*out))


def _merged(s: np.ndarray, e: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs: stretches of one period that share a period or more are one."""
    order = np.lexsort((s, q))
    s, e, q = s[order], e[order], q[order]
    if len(s):
        kind = np.cumsum(np.r_[0, q[1:] != q[:-1]])
        far = kind * (int(e.max()) + 1)
        until = np.maximum.accumulate(e + far) - far
        fresh = np.r_[True, (q[1:] != q[:-1]) | (s[1:] > until[:-1] - q[1:])]
        heads = np.flatnonzero(fresh)
        s, q, e = s[heads], q[heads], until[np.r_[heads[1:], len(s)] - 1]
    # The same stretch under several periods has the smallest.
    order = np.lexsort((q, e, s))
    s, e, q = s[order], e[order], q[order]
    kept = np.r_[True, (s[1:] != s[:-1]) | (e[1:] != e[:-1])][: len(s)]
    s, e, q = s[kept], e[kept], q[kept]
    order = np.lexsort((q, s))
    return s[order], e[order], q[order]


def runs_of(words: np.ndarray, starts: np.ndarray, least: int = 24, times: int = 3) -> tuple:
    """All runs of several texts: start, end and period, by start and period.

    ``words`` numbers the words of all texts in a row, from 0; ``starts`` holds
    where texts begin and, last, their end.
    """
    none = np.zeros(0, np.int64)
    if not len(words):
        return none, none, none
    starts = np.unique(starts)
    ends = np.repeat(starts[1:], np.diff(starts))
    grammar = re_pair(words, starts, int(words.max()) + 1)
    rules = np.flatnonzero((grammar.left >= 0) & (grammar.size >= least))
    top = grammar.top_at[np.r_[False, ends[grammar.top_at[1:]] == ends[grammar.top_at[:-1]]]]
    begins = np.repeat(starts[:-1], np.diff(starts))
    top = top[ends[top] - begins[top] >= least]
    lo = np.r_[grammar.first[rules], begins[top]]
    mid = np.r_[grammar.first[rules] + grammar.size[grammar.left[rules]], top]
    hi = np.r_[grammar.first[rules] + grammar.size[rules], ends[top]]
    row, s, e, q = crossing(words, ends, lo, mid, hi, least, times)
    ruled = row < len(rules)
    rule = rules[row[ruled]]
    moved = _derived(grammar, rule, s[ruled] - grammar.first[rule], e[ruled] - grammar.first[rule], q[ruled])
    return _merged(*(np.r_[a, b[~ruled]] for a, b in zip(moved, (s, e, q))))


RUN = "struct<start:bigint,length:bigint,period:bigint>"
SCHEMA = f"doc_id long, n_words long, runs array<{RUN}>, longest {RUN}, collapsed string"


def _read(batch: pa.RecordBatch, order: Order | None) -> Iterator[list[bytes]]:
    """Words of each text, in the order in which they are to be read."""
    for key, text in zip(batch.column("doc_id").to_pylist(), texts(batch)):
        words = text.encode().split()  # the six white space characters of ASCII
        index = order(key, len(words)) if order and words else None
        yield words if index is None else [words[i] for i in index.tolist()]


def find_runs(docs: DataFrame, order: Order | None = None, least: int = 24, times: int = 3) -> DataFrame:
    """``(doc_id, n_words, runs, longest, collapsed)`` for every row.

    Words are what ASCII white space parts.  ``runs`` are the stretches of words
    with smallest period q that no neighbouring word extends, of ``least`` words
    and ``times`` periods at least, by start, then period; ``longest`` is the one
    of most periods (ties: smallest start, then period; null without runs);
    ``collapsed`` the words joined by one space, without those that a run holds
    after its first period.  With ``order`` the words of a text are first
    arranged as it says.

    Null and empty texts have no words, no runs and an empty ``collapsed``; a null
    id stays null; repeated rows get a row each; other columns are left out; an
    empty table gives an empty one.  A text of any length is read whole: memory
    grows with the longest text, not with the number of its repetitions.
    """

    def work(batch: pa.RecordBatch) -> dict:
        each = list(_read(batch, order))
        counts = np.fromiter(map(len, each), np.int64, len(each))
        # Shorter texts hold no run.
        able = np.flatnonzero(counts >= least)
        starts = np.r_[0, np.cumsum(counts[able])]
        flat = pa.array([w for i in able.tolist() for w in each[i]], pa.binary()).dictionary_encode()
        words = flat.indices.to_numpy().astype(np.int64)
        s, e, q = runs_of(words, starts, least, times)
        cut = np.searchsorted(s, starts)
        out: dict[str, list] = {
            "doc_id": batch.column("doc_id"),
            "n_words": counts,
            "runs": [[] for _ in each],
            "longest": [None] * len(each),
            "collapsed": [],
        }
        for k, i in enumerate(able.tolist()):
            if cut[k] == cut[k + 1]:
                continue
            own = slice(cut[k], cut[k + 1])
            begin, end, period = s[own] - starts[k], e[own] - starts[k], q[own]
            runs = [
                {"start": a, "length": b - a, "period": p}
                for a, b, p in zip(begin.tolist(), end.tolist(), period.tolist())
            ]
            best = runs[0]
            for run in runs[1:]:  # in order of start and period: later ones must be longer
                if run["length"] * best["period"] > best["length"] * run["period"]:
                    best = run
            step = np.zeros(counts[i] + 1, np.int64)
            np.add.at(step, begin + period, 1)
            np.add.at(step, end, -1)
            kept = np.flatnonzero(np.cumsum(step[:-1]) == 0)
            each[i] = [each[i][j] for j in kept.tolist()]
            out["runs"][i], out["longest"][i] = runs, best
        out["collapsed"] = [b" ".join(words).decode() for words in each]
        return out

    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    return map_batches(rows, work, SCHEMA, size=2 << 20)
