"""Queries and postings packed into blocks that meet pair by pair: scores are summed up in arrays, so what a query touches never becomes rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a block, about.
QUERY_ROWS, POSTINGS = 50_000, 250_000


def parts(rows: DataFrame, per: int) -> int:
    """How many blocks of about `per` rows these make; `rows` is counted, so it should be a table."""
    return max(1, -(-rows.count() // per))


def packed(rows: DataFrame, by: Column, n: int, name: str, first: str) -> DataFrame:
    """(name): a row a block, n at most, each with the rows of equal hash of `by` as an Arrow stream; sorted by `first` and the term, or by the term and `doc_id`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        coded = t["term"].combine_chunks().dictionary_encode()
        order = pc.array_sort_indices(coded.dictionary)  # sums of doubles depend on the order of terms
        place = np.empty(len(order) + 1, np.int32)
        place[order.to_numpy()], place[-1] = np.arange(len(order)), -1  # a missing term stays -1
        codes = place[coded.indices.fill_null(-1).to_numpy()]
        keys = (codes, t[first].to_numpy()) if first != "term" else (t["doc_id"].to_numpy(), codes)
        at = np.lexsort(keys)
        t = t.drop_columns("term").take(pa.array(at))
        codes = codes[at]
        t = t.append_column("term", pa.DictionaryArray.from_arrays(pa.array(codes, mask=codes < 0), coded.dictionary.take(order)))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.schema) as out:
            out.write_table(t.combine_chunks())
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["part", name])

    rows = rows.repartitionById(n, F.pmod(F.xxhash64(by), F.lit(n)).cast("int"))
    return rows.mapInArrow(run, f"part int, {name} binary").repartitionById(n, "part").select(name)


def met(queries: DataFrame, nq: int, postings: DataFrame, nd: int, by: Column, kernel: Callable, schema: str) -> DataFrame:
    """What `kernel` makes of each block of `queries` (user_idx, term, ...) beside each block of `postings` (doc_id, term, ...)."""
    return paired(packed(queries, F.col("user_idx"), nq, "q", "user_idx"), packed(postings, by, nd, "d", "term"), kernel, schema)


def paired(q: DataFrame, d: DataFrame, kernel: Callable, schema: str) -> DataFrame:
    """The same for blocks that are packed already. Every pair of blocks is a task of its own. Nothing is copied for it: a task reads both from their shuffle files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                own, lists = (pa.ipc.open_stream(b.column(c)[i].as_buffer()).read_all() for c in range(2))
                yield from kernel(Asked(own), Lists(lists))

    return q.hint("shuffle_replicate_nl").crossJoin(d).mapInArrow(run, schema)


class Lists:
    """A block of postings by term: `start` of each list, and the documents by their places in `ids`, which is in order."""

    def __init__(self, t: pa.Table):
        term = t["term"].combine_chunks()
        self.table, self.terms, self.codes = t, term.dictionary, term.indices.fill_null(-1).to_numpy()
        self.ids, self.doc = np.unique(t["doc_id"].to_numpy(), return_inverse=True)
        self.start = np.searchsorted(self.codes, np.arange(len(self.terms) + 1))
        self.sizes = np.diff(self.start)

    def column(self, name: str) -> np.ndarray:
        return self.table[name].to_numpy().astype(np.float64, copy=False)


class Asked:
    """A block of queries by user."""

    def __init__(self, t: pa.Table):
        self.table, self.q = t, t["q"].to_numpy().astype(np.float64, copy=False)
        self.users, first = np.unique(t["user_idx"].to_numpy(), return_index=True)
        self.ends = [*first, t.num_rows]

    def of(self, lists: Lists) -> np.ndarray:
        """The code in `lists` of each row's term, -1 where it has none."""
        term = self.table["term"].combine_chunks()
        there = pc.index_in(term.dictionary, value_set=lists.terms).fill_null(-1).to_numpy()
        return np.append(there, -1)[term.indices.fill_null(-1).to_numpy()]

    def each(self, lists: Lists) -> Iterator[tuple]:
        """(place, user, codes, q) of each user with a term there."""
        codes = self.of(lists)
        for i, user in enumerate(self.users):
            c, q = codes[(s := slice(self.ends[i], self.ends[i + 1]))], self.q[s]
            if (has := c >= 0).any():
                yield i, user, c[has], q[has]


def opened(start: np.ndarray, codes: np.ndarray) -> list[slice]:
    """The lists of some terms."""
    return [slice(a, b) for a, b in zip(start[codes].tolist(), start[codes + 1].tolist())]


def taken(values: np.ndarray, lists: list[slice]) -> np.ndarray:
    """The values of all postings of some lists: copied list by list, which is far cheaper than by their places."""
    return np.concatenate([values[x] for x in lists])


def batch(rows: list[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of (user, array, array ...) as one batch; the user is repeated, a scalar stands for an array of one."""
    if rows:
        columns = [np.repeat(np.array([r[0] for r in rows]), [np.size(r[1]) for r in rows]), *(np.concatenate([np.atleast_1d(r[j]) for r in rows]) for j in range(1, len(names)))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def first_k(ids: np.ndarray, s: np.ndarray, k: int, digits: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The k of greatest score, rounded first where `digits` says so, equal ones by id."""
    if len(s) > k:
        keep = s >= np.partition(s, len(s) - k)[len(s) - k] - (0 if digits is None else 2 * 10.0**-digits)
        ids, s = ids[keep], s[keep]
    s = s if digits is None else np.round(s, digits)
    at = np.lexsort((ids, -s))[:k]
    return ids[at], s[at]


def best(k: int, digits: int | None = None) -> Callable:
    """Kernel: (user_idx, doc_id, score) of the k best documents of each query in a block; scores rounded first where `digits` says so."""

    def run(asked: Asked, lists: Lists) -> Iterator[pa.RecordBatch]:
        rows, w = [], lists.column("w")
        for _, user, codes, q in asked.each(lists):
            own = opened(lists.start, codes)
            rows.append((user, *_best(lists, taken(lists.doc, own), taken(w, own) * np.repeat(q, lists.sizes[codes]), k, digits)))
        yield from batch(rows, ["user_idx", "doc_id", "score"])

    return run


def _sums(lists: Lists, doc: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(s, shares) by document: its sum, and whether it has a part."""
    s = np.bincount(doc, part, len(lists.ids))
    if len(part) and part.min() > 0:
        shares = s > 0
    else:
        shares = np.zeros(len(lists.ids), bool)
        shares[doc] = True
    return s, shares


def _best(lists: Lists, doc: np.ndarray, part: np.ndarray, k: int, digits: int | None) -> tuple[np.ndarray, np.ndarray]:
    s, shares = _sums(lists, doc, part)
    return first_k(lists.ids[shares], s[shares], k, digits)


class Spans:
    """The bounds of spans of document ids: the largest weight and the number of a term's postings in each. A span lies in one block."""

    def __init__(self, lists: Lists, w: np.ndarray, span: int):
        _, of = np.unique(lists.ids // span, return_inverse=True)
        self.of = of[lists.doc]  # of each posting
        self.n = len(lists.ids) and of[-1] + 1
        new = np.flatnonzero((np.diff(self.of, prepend=-1) != 0) | (np.diff(lists.codes, prepend=-1) != 0))
        self.top, self.size, self.span = np.maximum.reduceat(w, new), np.diff(new, append=len(w)).astype(np.float64), self.of[new]
        self.start = np.searchsorted(lists.codes[new], np.arange(len(lists.terms) + 1))

    def open(self, codes: np.ndarray, q: np.ndarray, edge: float) -> tuple[np.ndarray, np.ndarray]:
        """(n, open) by span: the query's postings there, and whether it may hold one of the best; a missing edge opens all that have some."""
        own = opened(self.start, codes)
        span = taken(self.span, own)
        n = np.bincount(span, taken(self.size, own), self.n).astype(np.int64)
        if np.isnan(edge):
            return n, n > 0
        return n, (n > 0) & (np.bincount(span, taken(self.top, own) * np.repeat(q, self.start[codes + 1] - self.start[codes]), self.n) >= edge - 1e-6)


    def sums(self, user: np.ndarray, users: int, codes: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n, bound) by user and span: the user's postings there, and the sum of q x the largest weight. A row of user, code and q a term, in order of users."""
        size = np.diff(self.start)
        common = np.bincount(codes, minlength=len(size)) * size * ALONE > users * self.n
        n, bound = np.zeros((users, self.n)), np.zeros((users, self.n))
        table = lambda at, what, i, j: np.bincount(at, what, i * j).reshape(i, j)
        terms, place, width = np.flatnonzero(common), np.full(len(size), -1), max(1, CELLS // max(users, self.n))
        for low in range(0, len(terms), width):
            own = terms[low : low + width]
            place[own] = np.arange(len(own))
            x = np.flatnonzero(place[codes] >= 0)
            asks = user[x] * len(own) + place[codes[x]]
            of = opened(self.start, own)
            has = np.repeat(np.arange(len(own)) * self.n, size[own]) + taken(self.span, of)
            bound += table(asks, q[x], users, len(own)) @ table(has, taken(self.top, of), len(own), self.n)
            n += table(asks, None, users, len(own)).astype(np.float32) @ table(has, taken(self.size, of), len(own), self.n).astype(np.float32)  # whole numbers, exact
            place[own] = -1
        x = np.flatnonzero(~common[codes])
        done = np.cumsum(size[codes[x]])
        for part in np.split(x, np.searchsorted(done, np.arange(OPENED, done[-1], OPENED))) if len(x) else []:
            if len(part):
                long = size[codes[part]]
                entry = np.repeat(self.start[codes[part]] - (np.cumsum(long) - long), long) + np.arange(long.sum())
                first, last = user[part[0]], user[part[-1]] + 1
                cell = np.repeat((user[part] - first) * self.n, long) + self.span[entry]
                n[first:last] += table(cell, self.size[entry], last - first, self.n)
                bound[first:last] += table(cell, self.top[entry] * np.repeat(q[part], long), last - first, self.n)
        return n, bound


def best_pruned(k: int, span: int, digits: int) -> Callable:
    """Kernel: as `best`, without the scores of documents in spans whose bound is under the query's `edge`."""

    def run(asked: Asked, lists: Lists) -> Iterator[pa.RecordBatch]:
        rows, w = [], lists.column("w")
        spans, edge = Spans(lists, w, span), asked.table["edge"].to_numpy()
        for i, user, codes, q in asked.each(lists):
            _, open_ = spans.open(codes, q, edge[asked.ends[i]])
            own = opened(lists.start, codes)
            left = open_[taken(spans.of, own)]
            rows.append((user, *_best(lists, taken(lists.doc, own)[left], taken(w, own)[left] * np.repeat(q, lists.sizes[codes])[left], k, digits)))
        yield from batch(rows, ["user_idx", "doc_id", "score"])

    return run


#: Cells of an array of queries by spans at a time, about; postings opened at once; and what a posting opened alone costs, in cells of a product of arrays.
CELLS, OPENED, ALONE = 1_000_000, 1_000_000, 400


def upto(lists: Lists, end: float) -> Lists:
    """The same block without the documents behind `end`."""
    n = int(np.searchsorted(lists.ids, end, "right"))
    return lists if n == len(lists.ids) else Lists(lists.table.filter(pa.array(lists.doc < n)))


def sure(k: int, seeds: int, sets: list[str], ends: list[float]) -> Callable:
    """Kernel: (user_idx, v, doc_id, s, full), for each set of weights and each end the 4 k documents of a block, up to that end, of greatest score by the
    `seeds` terms of greatest bound: that score, and the score by all terms. `top0`, `top1` ... have the greatest weight of a row's term up to each end.
    """

    def run(asked: Asked, lists: Lists) -> Iterator[pa.RecordBatch]:
        codes, w, rows = asked.of(lists), lists.column("w"), []
        tops = [asked.table[f"top{e}"].to_numpy() for e in range(len(ends))]
        before = [int(np.searchsorted(lists.ids, end, "right")) for end in ends]
        by_doc = np.argsort(lists.doc, kind="stable")
        code_of, w_of = lists.codes[by_doc], w[by_doc]
        first = np.searchsorted(lists.doc[by_doc], np.arange(len(lists.ids) + 1))
        for j, name in enumerate(sets):
            every, weight = asked.table[name].to_numpy().astype(np.float64, copy=False), np.zeros(len(lists.terms))
            for i, user in enumerate(asked.users):
                own = np.arange(asked.ends[i], asked.ends[i + 1])
                own = own[~np.isnan(every[own])]
                q, c, known = every[own], codes[own], {}
                here = c >= 0
                if not here.any():
                    continue
                found = []
                for e, n in enumerate(before):
                    at = np.argsort(-q * tops[e][own], kind="stable")[:seeds]  # rows are in order of terms, missing bounds come last
                    at = np.sort(at[(c[at] >= 0) & ~np.isnan(tops[e][own[at]])])
                    if not len(at) or not n:
                        continue
                    if (key := at.tobytes()) not in known:
                        of = opened(lists.start, c[at])
                        known[key] = _sums(lists, taken(lists.doc, of), taken(w, of) * np.repeat(q[at], lists.sizes[c[at]]))
                    s, shares = (x[:n] for x in known[key])
                    place, s = first_k(np.flatnonzero(shares), s[shares], 4 * k, None)
                    if len(place):
                        found.append((np.full(len(place), j * len(ends) + e), place, s))
                if found:
                    v, place, s = (np.concatenate(x) for x in zip(*found))
                    weight[c[here]] = q[here]
                    size = first[place + 1] - first[place]
                    start = np.cumsum(size) - size
                    x = np.repeat(first[place] - start, size) + np.arange(size.sum())
                    rows.append((user, v, lists.ids[place], s, np.add.reduceat(weight[code_of[x]] * w_of[x], start)))
                    weight[c[here]] = 0
        yield from batch(rows, ["user_idx", "v", "doc_id", "s", "full"])

    return run


def span_sums(span: int, sets: list[str], ends: list[float]) -> Callable:
    """Kernel: (user_idx, v, touched, opened, spans, open_spans) of each query in a block, for each set of weights and each end, by its edge `e0`, `e1` ...

    Bounds of many queries are one product of arrays, of queries by terms and of terms by spans, for the terms that many
    queries and many spans have; only the postings of others are opened one by one.
    """

    def run(asked: Asked, lists: Lists) -> Iterator[pa.RecordBatch]:
        sizes = np.diff(asked.ends)
        for e, end in enumerate(ends):
            if not len((near := upto(lists, end)).ids):
                continue
            spans, codes = Spans(near, near.column("w"), span), asked.of(near)
            for j, name in enumerate(sets):
                v = j * len(ends) + e
                q, edge = asked.table[name].to_numpy().astype(np.float64, copy=False), asked.table[f"e{v}"].to_numpy()[asked.ends[:-1]]
                row = np.flatnonzero((codes >= 0) & ~np.isnan(q))
                user = np.repeat(np.arange(len(sizes)), sizes)[row]
                step = max(1, CELLS // spans.n)
                for low in range(0, len(sizes), step):
                    s = slice(*np.searchsorted(user, (low, low + step)))
                    users = asked.users[low : low + step]
                    n, bound = spans.sums(user[s] - low, len(users), codes[row[s]], q[row[s]])
                    some, here = n > 0, edge[low : low + step, None]
                    open_ = some & (np.isnan(here) | (bound >= here - 1e-6))
                    got = [n.sum(1), np.where(open_, n, 0).sum(1), some.sum(1), open_.sum(1)]
                    yield from batch([(users[i], v, *(int(x[i]) for x in got)) for i in np.flatnonzero(got[0])], ["user_idx", "v", "touched", "opened", "spans", "open_spans"])

    return run


def scored(asked: Asked, lists: Lists) -> Iterator[pa.RecordBatch]:
    """Kernel: (user_idx, n), the documents of a block that share a term with each query."""
    rows = []
    for _, user, codes, q in asked.each(lists):
        shares = np.zeros(len(lists.ids), bool)
        shares[taken(lists.doc, opened(lists.start, codes))] = True
        rows.append((user, shares.sum()))
    yield from batch(rows, ["user_idx", "n"])


def ahead(points: list[tuple[float, float]], enough: int) -> Callable:
    """Kernel: (user_idx, doc_id, c0, c1 ...), for each row without a term, with its scores `s` by (k1, b), the documents of a block that rank before it at each.

    A score is a sum over the distinct counts of a document's terms, so one pass over the postings serves all points. Counts
    that have come to `enough` at every point aren't carried on, so the documents are taken in ever larger stretches.
    """
    k1, b = (np.array(x)[:, None] for x in zip(*points))

    def stretches(lists: Lists) -> Iterator[tuple]:
        tf, long, idf, end, step = lists.column("tf"), lists.column("long"), lists.column("idf"), 0, 512
        while end < len(lists.ids):
            here = np.flatnonzero((lists.doc >= end) & (lists.doc < end + step))  # in order of terms still
            pairs, cell = np.unique(np.stack([lists.doc[here], tf[here].astype(np.int64)], 1), axis=0, return_inverse=True)
            per = np.zeros(len(pairs))
            per[cell := cell.ravel()] = long[here]
            part = pairs[:, 1] * (k1 + 1) / (pairs[:, 1] + k1 * (1 - b + b * per))
            docs, first = np.unique(pairs[:, 0], return_index=True)
            yield lists.ids[docs], first, part, cell, idf[here], np.searchsorted(lists.codes[here], np.arange(len(lists.terms) + 1))
            end, step = end + step, 2 * step

    def run(asked: Asked, lists: Lists) -> Iterator[pa.RecordBatch]:
        is_pair, codes = asked.table["term"].combine_chunks().is_null().to_numpy(zero_copy_only=False), asked.of(lists)
        left, done = {}, {}
        for i, user in enumerate(asked.users):
            s = slice(asked.ends[i], asked.ends[i + 1])
            if (own := np.flatnonzero(is_pair[s]) + asked.ends[i]).size:
                has = codes[s] >= 0
                at = pa.array(own)
                score = asked.table["s"].take(at).combine_chunks().flatten().to_numpy().reshape(len(own), len(points))
                left[user] = (codes[s][has], asked.q[s][has], asked.table["doc_id"].take(at).to_numpy(), score, np.zeros(score.shape, np.int64))
        live = [u for u, x in left.items() if len(x[0])]
        for ids, first, part, cell, idf, start in stretches(lists):
            still = []
            for u in live:
                c, q, doc, score, n = left[u]
                own = opened(start, c)
                sums = np.bincount(taken(cell, own), taken(idf, own) * np.repeat(q, start[c + 1] - start[c]), part.shape[1])
                all_ = np.round(np.add.reduceat(part * sums, first, axis=1), 9)
                for p, (row, sorted_) in enumerate(zip(all_, np.sort(all_, axis=1))):
                    low, high = np.searchsorted(sorted_, score[:, p], "left"), np.searchsorted(sorted_, score[:, p], "right")
                    n[:, p] += len(ids) - high
                    for j in np.flatnonzero(high > low):  # equal scores go by id
                        n[j, p] += np.count_nonzero(ids[row == score[j, p]] < doc[j])
                if (n < enough).any():
                    going = (n < enough).any(axis=1)
                    if not going.all():
                        done.setdefault(u, []).append((doc[~going], n[~going]))
                        left[u] = (c, q, doc[going], score[going], n[going])
                    still.append(u)
            live = still
        rows = [(u, x[2], *x[4].T) for u, x in left.items()] + [(u, doc, *n.T) for u, parts_ in done.items() for doc, n in parts_]
        yield from batch(rows, ["user_idx", "doc_id", *(f"c{p}" for p in range(len(points)))])

    return run
