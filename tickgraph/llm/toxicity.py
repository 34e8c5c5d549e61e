"""Toxicity: Levenshtein automata of a learned lexicon, intersected with its trie, and scores of context windows."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytescan as B
from .decontaminate import carried
from .labelled import remainder, sample
from ..sources.scratch import Scratch

#: Words that report what others said, and quotation marks.
REPORTING = "said says say wrote writes called calls quote quoted quotes term word words phrase slur".split()
QUOTES = "\"“”„«»‹›"
_INNER = "*@$0123456789"

#: Bytes of states that an automaton keeps from one batch to the next, what Python needs for each included.
HELD = 64 << 20
_OVERHEAD = 192
#: Share of the weight of a match that 0, 1 or 2 errors leave.
NEARNESS = np.array([1.0, 0.6, 0.35])
_LETTER, _DIGIT_OR_SIGN = 1, 2


def _fold_table() -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code point and kind of each code point below 0x3000; above, all but common blanks are letters."""
    fold = np.arange(0x3000, dtype=np.uint32)
    kind = np.zeros(0x3000, np.uint8)
    for cp in range(0x3000):
        c = chr(cp)
        low = c.lower()
        if len(low) == 1 and ord(low) < 0x3000:
            fold[cp] = ord(low)
        kind[cp] = _LETTER if c.isalpha() else _DIGIT_OR_SIGN if c in _INNER else 0
    return fold, kind


FOLD, KIND = _fold_table()


def words_in(data: np.ndarray, offsets: np.ndarray):
    """Code points (lower case), starts and ends of words, words before each text, and where quotation marks stand.

    A word is a run of letters; digits and * @ $ between letters belong to it, as they stand for letters there.
    """
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    bounds = lead[offsets]
    low = np.minimum(codes, 0x2FFF)
    folded = np.where(codes < 0x3000, FOLD[low], codes)
    kind = np.where(codes < 0x3000, KIND[low], _LETTER)
    n = len(codes)
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    letter = kind == _LETTER
    inner = kind == _DIGIT_OR_SIGN
    at = np.arange(n, dtype=np.int32 if n < 2**31 else np.int64)
    last_letter = np.maximum.accumulate(np.where(letter | edge[:n], at, -1))
    broken = np.maximum.accumulate(np.where(~letter & ~inner | edge[:n] & ~letter, at, -1))
    left = inner & (last_letter > broken)
    next_letter = np.minimum.accumulate(np.where(letter | edge[1:], at, n)[::-1])[::-1]
    next_break = np.minimum.accumulate(np.where(~letter & ~inner | edge[1:] & ~letter, at, n)[::-1])[::-1]
    inside = letter | left & (next_letter < next_break)
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    ends[:-1] &= ~inside[1:] | edge[1:n]
    starts = np.flatnonzero(begins)
    quotes = np.flatnonzero(np.isin(codes, np.array([ord(q) for q in QUOTES], np.uint32)))
    return folded, starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, bounds), quotes, bounds


class Automaton:
    """Of terms (whole words, or stems that any ending may follow): accepts words within an edit distance of a term.

    States are sets of (trie node, errors) as the Levenshtein automata and the trie are walked together. All words of a
    batch are run through a table letter by letter; a place of the table is worked out when the first word comes to it,
    so it holds what the words reach and not all that terms allow, and it starts anew beyond HELD bytes of states. An
    exact term has distance 0; 1 error is allowed from 5 letters on and 2 from 8 on. A swap of neighbours counts as one
    error.
    """

    def __init__(self, terms: list[tuple[str, bool]]):
        self.terms = sorted(set(terms))
        self.limit = limit = [2 if len(t) >= 8 else 1 if len(t) >= 5 else 0 for t, _ in self.terms]
        letters = sorted({c for t, _ in self.terms for c in t})
        self.letters = {c: k + 1 for k, c in enumerate(letters)}
        self.width = len(letters) + 1  # 0 stands for all letters that no term has
        children: list[dict[str, int]] = [{}]
        final: list[list[int]] = [[]]
        reach: list[int] = [0]
        for k, (term, _) in enumerate(self.terms):
            node = 0
            most = limit[k]
            reach[0] = max(reach[0], most)
            for c in term:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    final.append([])
                    reach.append(0)
                node = children[node][c]
                reach[node] = max(reach[node], most)
            final[node].append(k)

        self.children, self.final, self.reach, self.symbols = children, final, reach, [None, *letters]
        self.points = np.array([ord(c) for c in letters], np.uint32)
        self.code = np.zeros(0x3000, np.int32)
        for c, k in self.letters.items():
            if ord(c) < 0x3000:
                self.code[ord(c)] = k
        self._restart()

    def _restart(self) -> None:
        self.number: dict[bytes, int] = {}
        self.states: list[bytes] = [b""]
        self.held = 0
        self.table = np.zeros((64, self.width), np.int32)
        self.label = np.zeros(64, np.int32)
        self._numbered(self._closed({(0, None): 0}))

    def _closed(self, items: dict) -> dict:
        """Adds what leaving out letters of a term reaches; keeps the fewest errors of each place."""
        children, reach = self.children, self.reach
        todo = list(items.items())
        while todo:
            (node, held), e = todo.pop()
            if held is None and e < reach[node] and node >= 0:
                for child in children[node].values():
                    if e + 1 <= reach[child] and items.get((child, None), 9) > e + 1:
                        items[(child, None)] = e + 1
                        todo.append(((child, None), e + 1))
        done: dict = {}
        for (n, h), e in items.items():
            for k in self.final[n] if h is None and n >= 0 else ():
                if self.terms[k][1] and e <= self.limit[k]:
                    done[(~k, None)] = min(e, done.get((~k, None), 9))
        for key, e in done.items():
            if items.get(key, 9) > e:
                items[key] = e
        over = {key: e for key, e in items.items() if key[0] < 0}
        if over:  # a stem is complete: what has more errors cannot be nearer, and nothing is nearer than none
            best = min(over.values())
            items = dict([min(over.items(), key=lambda x: (x[1], ~x[0][0]))]) if not best else {k: e for k, e in items.items() if e <= best}
        return items

    def _numbered(self, items: dict) -> int:
        """The number of a state, from 1 on; a new one has a row of places not worked out (-1)."""
        places = ((n << 41) + ((h[1] << 18) + (self.letters[h[0]] << 2) if h else 0) + e for (n, h), e in items.items())
        name = np.array(sorted(places), np.int64).tobytes()
        if name not in self.number:
            k = self.number[name] = len(self.states)
            self.states.append(name)
            self.held += len(name) + 4 * self.width + _OVERHEAD
            if k == len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                self.label = np.concatenate([self.label, np.zeros_like(self.label)])
            self.table[k] = -1
            found: dict[int, int] = {}
            for (node, held), e in items.items():
                for t in () if held is not None else [~node] if node < 0 else self.final[node]:
                    if e <= self.limit[t]:
                        found[t] = min(found.get(t, 9), e)
            if found:
                e, t = min((e, t) for t, e in found.items())
                self.label[k] = 1 + 3 * t + e
        return self.number[name]

    def _after(self, state: int, symbol: int) -> int:
        """The state that a letter leads to, 0 if no term is near any more."""
        children, reach, c = self.children, self.reach, self.symbols[symbol]
        new: dict = {}

        def put(key, e):
            if new.get(key, 9) > e:
                new[key] = e

        for place in np.frombuffer(self.states[state], np.int64).tolist():
            node, then, letter, e = place >> 41, place >> 18 & 0x7FFFFF, place >> 2 & 0xFFFF, place & 3
            if node < 0:
                put((node, None), e)
                continue
            if letter:
                if symbol == letter:
                    put((then, None), e)
                continue
            if c in children[node]:
                put((children[node][c], None), e)
            if e + 1 > reach[node]:
                continue
            put((node, None), e + 1)
            for letter, child in children[node].items():
                if e + 1 <= reach[child]:
                    put((child, None), e + 1)
                if c is not None and letter != c and c in children[child] and e + 1 <= reach[children[child][c]]:
                    put((node, (letter, children[child][c])), e + 1)
        return self._numbered(self._closed(new)) if new else 0

    def run(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each word 0, or 1 + 3 * term + errors of its nearest term."""
        classes = self.code[np.minimum(codes, 0x2FFF)]
        far = np.flatnonzero(codes >= 0x3000)
        if len(far):
            at = np.searchsorted(self.points, codes[far])
            same = at < len(self.points)
            same[same] = self.points[at[same]] == codes[far][same]
            classes[far] = np.where(same, at + 1, 0)
        if self.held > HELD:
            self._restart()
        out = np.zeros(len(starts), np.int32)
        rows, state, at, stop = np.arange(len(starts)), np.ones(len(starts), np.int32), starts.copy(), ends
        while len(rows):
            symbol = classes[at]
            after = self.table[state, symbol]
            unknown = after < 0
            if unknown.any():
                for place in np.unique(state[unknown].astype(np.int64) * self.width + symbol[unknown]).tolist():
                    k, c = divmod(place, self.width)
                    target = self._after(k, c)  # may replace the table
                    self.table[k, c] = target
                after = self.table[state, symbol]
            state = after
            at = at + 1
            done = at == stop
            out[rows[done]] = self.label[state[done]]
            go = ~done & (state > 0)
            rows, state, at, stop = rows[go], state[go], at[go], stop[go]
        return out


def learn_lexicon(texts: DataFrame, least: int = 5, times: float = 30.0) -> list[tuple[str, bool]]:
    """Words and stems (of 4 to 10 letters) that labelled toxic texts have and clean ones do not.

    texts: (y, text). Counts are made on executors over words and stems; what comes to the driver passed the counts.
    """

    def run(batches):
        for part in (part for batch in batches for part in B.pieces_of(batch, "text")):
            counts: Counter = Counter()  # of a run of texts, as those of a whole batch fill a worker
            for y, text in zip(part.column("y").to_pylist(), part.column("text").to_pylist(), strict=True):
                own = set(re.findall(r"[^\W\d_]+", text.lower()))
                for w in own:
                    counts[w, False, y] += 1
                for p in {w[:n] for w in own for n in range(4, min(11, len(w)))}:
                    counts[p, True, y] += 1
            names = [(w, s, y, n) for (w, s, y), n in counts.items()]
            arrays = [pa.array([r[0] for r in names], pa.string()), pa.array([r[1] for r in names], pa.bool_())]
            arrays += [pa.array([r[3] if r[2] == y else 0 for r in names], pa.int64()) for y in (1, 0)]
            yield pa.RecordBatch.from_arrays(arrays, ["term", "stem", "toxic", "clean"])

    totals = {r[0]: r[1] for r in texts.groupBy("y").count().collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad or not good:
        return []
    sums = texts.mapInArrow(run, "term string, stem boolean, toxic long, clean long").groupBy("term", "stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    ratio = (F.col("toxic") / bad) / ((F.col("clean") + 0.5) / good)
    strong = sums.where((F.col("toxic") >= F.when(F.col("stem"), 2 * least).otherwise(least)) & (ratio >= times) & (F.length("term") >= 3))
    rows = strong.orderBy(F.desc("toxic"), "term", "stem").collect()
    words = {r["term"]: r["toxic"] for r in rows if not r["stem"]}
    stems: list[str] = []
    for r in sorted((r for r in rows if r["stem"]), key=lambda r: (len(r["term"]), r["term"])):
        stem, n = r["term"], r["toxic"]
        if any(stem.startswith(s) for s in stems):
            continue
        longest = max((c for w, c in words.items() if w.startswith(stem)), default=0)
        if longest < 0.6 * n:  # many endings, none of which makes up most of it
            stems.append(stem)
    kept = [(w, False) for w in words if not any(w.startswith(s) for s in stems)]
    kept.sort(key=lambda w: (-words[w[0]], w[0]))
    return kept + [(s, True) for s in stems]


def reports(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which words report what others said."""
    out = np.zeros(len(starts), bool)
    lengths = ends - starts
    for n in {len(w) for w in REPORTING}:
        mine = np.flatnonzero(lengths == n)
        for word in (w for w in REPORTING if len(w) == n):
            same = mine
            for k, c in enumerate(word):
                same = same[codes[starts[same] + k] == ord(c)]
            out[same] = True
    return out


def evidence(automaton: Automaton, data: np.ndarray, offsets: np.ndarray, window: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, weight) of each match: 2 * label for abuse, 2 * label + 1 for quotation.

    A match is quotation if an odd number of quotation marks stands before it in its line of words, within 4 * window
    words, or a reporting word within `window` words before it.
    """
    codes, starts, ends, before, quotes, bounds = words_in(data, offsets)
    label = automaton.run(codes, starts, ends)
    hit = np.flatnonzero(label)
    text = np.searchsorted(before, hit, side="right") - 1
    low = np.maximum(before[text], hit - 4 * window)
    marks = np.searchsorted(quotes, starts[hit]) - np.searchsorted(quotes, starts[low])
    after = np.searchsorted(quotes, bounds[text + 1]) - np.searchsorted(quotes, starts[hit])
    quoted = (marks % 2 == 1) & (after > 0)
    near = np.maximum(before[text], hit - window)
    so_far = np.concatenate([[0], np.cumsum(reports(codes, starts, ends))])
    quoted |= so_far[hit] > so_far[near]
    return text, 2 * label[hit] + quoted, np.ones(len(hit))


class Model:
    """Weights of log(1 + matches) of each kind, by logistic regression."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton
        kinds = 1 + 3 * len(automaton.terms)
        self.features = 2 * kinds + 2
        self.weights, self.base = np.zeros(self.features), 0.0
        self.shift = np.zeros(self.features, np.int64)

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, feature, value), one for each text and feature that has matches."""
        text, feature, _ = evidence(self.automaton, data, offsets)
        cell, n = np.unique(text * self.features + feature, return_counts=True)
        return cell // self.features, cell % self.features, np.log1p(n)

    def fit(self, text: np.ndarray, feature: np.ndarray, value: np.ndarray, y: np.ndarray, bare: tuple[int, int], ridge: float = 0.3) -> None:
        """All matches share a weight, less for more errors (NEARNESS); what errors and terms add to it is learned too.

        So a misspelling that no labelled text has is evidence as well. Quotation counts a quarter.

        y is of texts with matches; bare counts the clean and toxic texts without any, which are two rows with weights.
        """
        kind = np.where(feature // 2 > 0, (feature // 2 - 1) % 3, 0)
        quoted = feature % 2 == 1
        terms = len(self.automaton.terms)
        used, own = np.unique(np.maximum(feature // 2 - 1, 0), return_inverse=True)  # what does not occur has no weight of its own
        own = 3 + own
        width = 3 + len(used)
        times = np.concatenate([np.ones(len(y)), bare])
        y = np.concatenate([y, [0.0, 1.0]])
        x = np.zeros((len(y), width + 1))
        scaled = value * np.where(quoted, 0.25, 1.0)
        np.add.at(x, (text, 0), scaled * NEARNESS[kind])
        np.add.at(x, (text[kind > 0], kind[kind > 0]), scaled[kind > 0])
        np.add.at(x, (text, own), scaled)
        x[:, width] = 1
        w = np.zeros(width + 1)
        penalty = np.full(width + 1, ridge)
        penalty[width] = 1e-3
        penalty[3:width] = 3 * ridge

        def loss(v: np.ndarray) -> float:
            z = x @ v
            return float((times * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (penalty * v * v).sum())

        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (times * p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (times * (y - p)) - penalty * w)
            here = loss(w)
            while loss(w + step) > here and np.abs(step).max() > 1e-9:  # a whole Newton step may overshoot
                step = step / 2
            w += step
            if np.abs(step).max() < 1e-6:
                break
        self.base = float(w[width])
        alone = np.zeros(3 * terms)
        alone[used] = w[3:width]
        for f in range(2, self.features):
            label = f // 2 - 1
            if label < 3 * terms:
                errors = label % 3
                shared = w[0] * NEARNESS[errors] + (w[errors] if errors else 0.0)
                self.weights[f] = (shared + alone[label]) * (0.25 if f % 2 else 1.0)

    def probability(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        text, feature, value = self.rows(data, offsets)
        total = self.base + np.bincount(text, value * self.weights[feature], len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, most: int = 20_000) -> Model:
    """The model of labels.toxic from at most `most` labelled documents; lexicon, then weights of matches."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    texts = scratch.write(sample(docs, labels, "toxic", allowed, most).select("doc_id", "y", "text"))
    model = Model(Automaton(learn_lexicon(texts)))

    def run(batches):
        for batch in batches:
            for part in B.pieces_of(batch, "text"):
                text, feature, value = model.rows(*B.texts_of(part.column("text")))
                count = np.bincount(text, minlength=len(part))
                ends = pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (feature.astype(np.int64), value)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), *lists], ["doc_id", "y", "feature", "value"])

    found = scratch.write(texts.mapInArrow(run, "doc_id long, y int, feature array<long>, value array<double>"))
    rows = found.where("size(feature) > 0").orderBy("doc_id").collect()
    bare = {r["y"]: r["count"] for r in found.where("size(feature) = 0").groupBy("y").count().collect()}
    if rows:
        text = np.repeat(np.arange(len(rows)), [len(r["feature"]) for r in rows])
        feature = np.array([f for r in rows for f in r["feature"]], np.int64)
        value = np.array([v for r in rows for v in r["value"]], np.float64)
        model.fit(text, feature, value, np.array([r["y"] for r in rows], np.float64), (bare.get(0, 0), bare.get(1, 0)))
    else:
        model.base = float(np.log((bare.get(1, 0) + 0.5) / (bare.get(0, 0) + 0.5))) if bare else -5.0
    return model


def score(docs: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """(row, score): the probability of toxicity of each whole text, in one scan.

    Null text counts as empty; a text without matches has the base rate; repeated rows are scored each; an empty table
    gives no rows; extra columns are ignored unless carried.
    """
    source = carried(docs, carry or ["doc_id"])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in B.pieces_of(batch, "text"):
                p = shared.value.probability(*B.texts_of(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(p)], ["row", "score"])

    return source.mapInArrow(run, f"row {source.schema['row'].dataType.simpleString()}, score double")


def _learnable(modulus: int, held: int) -> Column:
    return F.coalesce(remainder("doc_id", modulus) != held, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted): learned only from rows whose id's crc32 leaves another remainder than `held`."""
    scored = score(docs, fit(docs, labels, _learnable(modulus, held)))
    return scored.select(F.col("row.doc_id").alias("doc_id"), "score").select(
        "doc_id",
        F.coalesce(remainder("doc_id", modulus) == held, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, modulus: int = 3, held: int = 1) -> DataFrame:
    """The documents that score below the threshold, with their own columns."""
    scored = score(docs, fit(docs, labels, _learnable(modulus, held)), docs.columns)
    return scored.where(F.col("score") < threshold).select("row.*")
