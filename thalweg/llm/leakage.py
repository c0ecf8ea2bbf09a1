"""Evaluation texts in training text: pigeonhole edit matching on words.

Every passage is cut into blocks, and every block into one piece more than its error budget. A block that occurs with
no more word errors than its budget leaves a piece untouched, so an exact search for pieces misses no such
occurrence. Each hit names a block and where it would lie; Myers' bit-parallel edit distance, over words instead of
letters, verifies it there, for all hits of a batch of documents at once. Pieces whose block is not there as a whole
are extended word by word; from LEAST_RUN words on they count, too. What was verified is chained in the order of the
passage, runs are extended over what a cut in mid-block left, and a passage counts as leaked if the words so found are
at least half of it. Passages shorter than two pieces have no error budget: they count where they occur whole.

Equal passages are searched once and joined to their items afterwards. The evaluation set goes to the executors in
blocks of a bounded number of passages and characters, one at a time; documents are read once per block, nothing about
them is collected, and only found pairs are ever shuffled.
"""

from __future__ import annotations

import functools
import html
import re
import unicodedata
import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from thalweg.session import materialise

#: Words of a piece and pieces of a block: a block of 16 words stands three word errors.
PIECE = 4
PIECES = 4
BLOCK = PIECE * PIECES
#: Part of the passage's words that makes a leak.
LEAST_PART = 0.5
#: Words of a run that counts though its block does not occur as a whole.
LEAST_RUN = 2 * PIECE
#: Distinct passages, and their characters, per broadcast block: tens of megabytes.
ITEMS_PER_BLOCK = 20_000
CHARACTERS_PER_BLOCK = 50_000_000
#: Documents that are searched together.
CHUNK = 500
#: Piece hits that are worked on together; where documents have more, they are searched in halves.
MOST_HITS = 2_000_000

_TAG = re.compile(r"<[^<>]{1,300}>")
_SIGNS = dict.fromkeys(map(chr, [0xA0, 0x85, 0x2002, 0x2003, 0x2009, 0x202F, 0x3000, 0x2010, 0x2011, 0x2012, 0x2013, 0x2014, 0x2015, 0x2022, 0x2026, 0xB7]), " ")
_SIGNS |= {chr(0xFB00): "ff", chr(0xFB01): "fi", chr(0xFB02): "fl", chr(0xFB03): "ffi", chr(0xFB04): "ffl", chr(0xFFFD): "\x01"}
_SIGN = re.compile("[" + "".join(_SIGNS) + "]")
_KEEP = bytes.maketrans(
    bytes(range(256)),
    bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c == 1 else 32 for c in range(256)),
)
#: Deleted rather than made blank: they stand inside words.
_INSIDE = b"'`?\x00\x7f"


# fixed values: where letters of other scripts than Latin lie, and those of scripts that set no blanks between words
_OTHER = (
    "\u0370-\u1cff\u1f00-\u1fff\u2c00-\u2c5f\u2c80-\u2dff\u2e80-\u2fdf\u3005-\u3007\u3021-\u3029\u3031-\u3035\u3041-\u318f\u31a0-\u31ff"
    "\u3400-\u4dbf\u4e00-\ua6ff\ua800-\uab2f\uab70-\ud7ff\uf900-\ufaff\ufb13-\ufdff\ufe70-\ufefc\uff66-\uffdc\U00010000-\U0001efff\U00020000-\U0003ffff"
)
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u2fdf\u3005-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9d\U00020000-\U0003ffff]")
_FOREIGN = re.compile(f"(?<![A-Za-z0-9{_OTHER}])[{_OTHER}]++(?![A-Za-z0-9])")
_WIDE = re.compile("[\uff01-\uff5e]")
#: Begins the plain form of a word of another script; its letters follow as numbers.
_MARK = "zq0"


def _spelt_out(match: re.Match) -> str:
    """Words of another script in plain letters and digits: lower case, without accents, a character of an unspaced script each."""
    out, word = [], []

    def end():
        if word:
            out.append(_MARK + "z".join(format(ord(c), "x") for c in word))
            word.clear()

    for c in unicodedata.normalize("NFKD", match.group().casefold()):
        if unicodedata.combining(c):
            continue
        if unicodedata.category(c)[0] not in "LMN":
            end()
        elif _UNSPACED.match(c):
            end()
            word.append(c)
            end()
        else:
            word.append(c)
    end()
    return f" {' '.join(out)} "


def _without_strays(words: list[str], known) -> list[str]:
    """Words less those stretches of other scripts of which no word is in any passage: mostly signs decoded wrongly."""
    out, k = [], 0
    while k < len(words):
        z = k
        while z < len(words) and words[z].startswith(_MARK):
            z += 1
        if z == k:
            out.append(words[k])
            k += 1
            continue
        if known is None or any(w in known for w in words[k:z]):
            out += words[k:z]
        k = z
    return out


def words_of(text: str | None, known=None) -> list[str]:
    """Lower-case words of any script, in plain letters and digits.

    Markup goes, character references and hyphenation at line ends are undone, and accented Latin letters are left out
    of words, so that a word reads the same however its accents were spelt, decoded wrongly or replaced. Words of other
    scripts are spelt out by number; scripts that set no blanks count by character. A replacement character may stand
    for a letter or for a space: it parts a word where `known` (a set of words) does not hold the word without it.
    """
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if "-\n" in text:
        text = text.replace("-\n", "")
    foreign = False
    if not text.isascii():
        text = _SIGN.sub(lambda m: _SIGNS[m.group()], text)
        text = _WIDE.sub(lambda m: chr(ord(m.group()) - 0xFEE0), text)
        text, n = _FOREIGN.subn(_spelt_out, text)
        foreign = n > 0
    plain = text.encode("ascii", "ignore").translate(_KEEP, _INSIDE).decode("ascii")
    words = plain.split()
    if foreign:
        words = _without_strays(words, known)
    if "\x01" not in plain:
        return words
    out = []
    for word in words:
        if "\x01" in word:
            joined = word.replace("\x01", "")
            if known is not None and joined not in known:
                out += [w for w in word.split("\x01") if w]
                continue
            word = joined
        if word:
            out.append(word)
    return out


def myers_batch(patterns: np.ndarray, sizes: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edit distance of each pattern to any stretch of its text, and how many words in that stretch ends.

    patterns: N x m word numbers (at most 63 a pattern, `sizes` of them used); texts: N x n word numbers, where 0
    equals nothing. Rows are independent and advance together, one text word a step.
    """
    n_rows, m = patterns.shape
    kind, bits = (np.uint32, 32) if m < 32 else (np.uint64, 64)
    one = kind(1)
    full = np.left_shift(one, sizes.astype(kind)) - one
    top = (sizes - 1).astype(kind)
    # the pattern's unused places hold -1, which no text word equals; a row of comparisons packs into one word
    same = np.zeros((n_rows, bits), bool)
    pattern = np.where(np.arange(m)[None, :] < sizes[:, None], patterns, -1)
    pattern[pattern == 0] = -1
    pv, mv = full.copy(), np.zeros(n_rows, kind)
    score = sizes.astype(np.int16)
    best, at = score.copy(), np.zeros(n_rows, np.int16)
    for j in range(texts.shape[1]):
        np.equal(pattern, texts[:, j, None], out=same[:, :m])
        eq = np.packbits(same, axis=1, bitorder="little").view(kind)[:, 0]
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        score += ((ph >> top) & one).astype(np.int16) - ((mh >> top) & one).astype(np.int16)
        ph = (ph << one) & full  # a stretch may begin anywhere: nothing enters at the low end
        mh = (mh << one) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        better = score < best
        np.copyto(best, score, where=better)
        at[better] = j + 1
    return best, at


class Passages:
    """Passages prepared for the search. Those of equal words are searched once; those without any are left out."""

    def __init__(self, items: list[tuple]):
        groups: dict[tuple, list] = defaultdict(list)
        for key, text in items:
            words = tuple(words_of(text))
            if key is not None and words:
                groups[words].append(key)
        self.keys = list(groups.values())
        self.number: dict[str, int] = {}
        self.ids = [np.array([self.number.setdefault(w, len(self.number) + 1) for w in words], np.int64) for words in groups]
        #: all passages in a row, and where each begins and ends
        self.flat = np.concatenate([np.zeros(0, np.int64), *self.ids])
        self.ends = np.cumsum([len(w) for w in self.ids], dtype=np.int64)
        self.starts = self.ends - np.array([len(w) for w in self.ids], np.int64)
        passage, begin, size = [], [], []
        short: dict[int, list[int]] = defaultdict(list)
        for p, words in enumerate(self.ids):
            if len(words) < 2 * PIECE:
                short[len(words)].append(p)
                continue
            edges = list(range(0, len(words), BLOCK)) or [0]
            if len(edges) > 1 and len(words) - edges[-1] < 2 * PIECE:
                edges.pop()  # a short end joins the block before it
            for a, z in zip(edges, [*edges[1:], len(words)]):
                passage.append(p)
                begin.append(a)
                size.append(z - a)
        self.passage, self.begin, self.size = (np.array(x, np.int64) for x in (passage, begin, size))
        self.first_block = np.searchsorted(self.passage, np.arange(len(self.ids) + 1))
        self.widest = int(self.size.max()) if len(self.size) else 1
        #: word numbers in the narrowest type that holds them
        self.kind = np.int16 if len(self.number) < 32_000 else np.int32
        self.pattern = np.zeros((len(self.size), self.widest), self.kind)
        pieces: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
        for b in range(len(self.size)):
            words = self.ids[self.passage[b]][self.begin[b] : self.begin[b] + self.size[b]]
            self.pattern[b, : len(words)] = words
            for k in range(0, len(words) - PIECE + 1, PIECE):
                pieces[tuple(words[k : k + PIECE])].append((b, k))
        #: per length of short passages: their codes in order, their words, their numbers
        self.short = []
        for n, ps in short.items():
            words, numbers = np.stack([self.ids[p] for p in ps]), np.array(ps)
            codes = self._codes(words)
            order = np.argsort(codes, kind="stable")
            self.short.append((n, codes[order], words[order], numbers[order]))
        codes = self._codes(np.array(list(pieces), np.int64).reshape(-1, PIECE))
        order = np.argsort(codes, kind="stable")
        self.codes = codes[order]
        self.exact = np.array(list(pieces), np.int64).reshape(-1, PIECE)[order]
        places = [pieces[k] for k in pieces]
        places = [places[i] for i in order]
        self.offset = np.concatenate([[0], np.cumsum([len(x) for x in places], dtype=np.int64)])
        flat = np.array([x for xs in places for x in xs], np.int64).reshape(-1, 2)
        self.hit_block, self.hit_at = flat[:, 0], flat[:, 1]

    @staticmethod
    def _codes(grams: np.ndarray) -> np.ndarray:
        code = np.zeros(len(grams), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(grams.shape[1]):
                code = code * np.uint64(0x9E3779B97F4A7C15) + grams[:, k].astype(np.uint64)
        return code

    @staticmethod
    def _lookup(flat: np.ndarray, n: int, codes: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in a word-number array at which one of some runs of n words begins, and its number."""
        if len(flat) < n or not len(codes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        m = len(flat) - n + 1
        grams = np.stack([flat[k : k + m] for k in range(n)], axis=1)
        where = np.flatnonzero((grams != 0).all(axis=1))
        grams = grams[where]
        own = Passages._codes(grams)
        k = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
        ok = (codes[k] == own) & (exact[k] == grams).all(axis=1)
        return where[ok], k[ok]

    def hits(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places at which a piece begins, and the piece's number."""
        return self._lookup(flat, PIECE, self.codes, self.exact)


Run = tuple[int, int, int, int, int]  # first and last word (excluded) in the passage and in the text, words that agree


def _chain(found: list[Run]) -> list[Run]:
    """The heaviest series of verified runs, in order in passage and text alike."""
    found = sorted(found, key=lambda x: (x[2], x[0]))
    best: list[tuple[int, int]] = []
    for i, (a, _, start, _, got) in enumerate(found):
        top, prev = got, -1
        for j in range(i):
            if found[j][1] <= a and found[j][3] <= start + PIECE and best[j][0] + got > top:
                top, prev = best[j][0] + got, j
        best.append((top, prev))
    at = max(range(len(found)), key=lambda i: best[i][0], default=-1)
    out = []
    while at >= 0:
        out.append(found[at])
        at = best[at][1]
    return out[::-1]


def _extension(words, text, wi: int, ti: int, step: int, room: int) -> tuple[int, int, int]:
    """(words that go on matching beyond a verified run, as long as any error is followed by two matches, and the
    places in passage and text where that ends)."""
    got = 0
    while room > 0 and 0 <= wi < len(words) and 0 <= ti < len(text):
        if words[wi] == text[ti]:
            got, wi, ti, room = got + 1, wi + step, ti + step, room - 1
            continue
        for dw, dt in ((1, 1), (0, 1), (1, 0)):  # replaced, inserted, left out
            a, b = wi + dw * step, ti + dt * step
            ends = (a, a + step, b, b + step)
            if min(ends) >= 0 and max(ends[:2]) < len(words) and max(ends[2:]) < len(text) and words[a] == text[b] and words[a + step] == text[b + step]:
                wi, ti, room = a, b, room - dw
                break
        else:
            break
    return got, wi, ti


#: How far from a piece the words that make it a run must begin to lie, and by how many places they may be shifted.
_REACH, _SHIFT = 3 * (LEAST_RUN - PIECE) // 2, (LEAST_RUN - PIECE) // 2


def _may_run(ps: Passages, flat: np.ndarray, passage: np.ndarray, word: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which pieces (of `passage`, from `word` on, at `place` of the text) can be extended to LEAST_RUN words at all.

    An extension matches at least two words after each error, so what a run lacks lies within _REACH words of the piece,
    shifted by no more than _SHIFT places: where fewer words agree there, whatever their order, there is no run.
    """
    agree = np.zeros(len(passage), np.int64)
    last = ps.ends[passage]
    first = ps.starts[passage]
    for off in [*range(-_REACH, 0), *range(PIECE, PIECE + _REACH)]:
        at = first + word + off
        inside = (at >= first) & (at < last)
        want = np.where(inside, ps.flat[np.clip(at, 0, len(ps.flat) - 1)], -1)
        hit = np.zeros(len(passage), bool)
        for shift in range(-_SHIFT, _SHIFT + 1):
            to = np.clip(place + off + shift, 0, len(flat) - 1)
            hit |= flat[to] == want
        agree += hit
    return agree >= LEAST_RUN - PIECE


def _runs(words: list[int], text: list[int], pieces: list[tuple[int, int]]) -> list[Run]:
    """Exact pieces (place in the passage, place in the text) extended to both sides, from LEAST_RUN words on."""
    out: list[Run] = []
    reached: dict[int, int] = {}  # by shift between passage and text: up to where it has been read
    for wi, ti in sorted(pieces, key=lambda x: x[1]):
        if reached.get(ti - wi, -1) >= ti + PIECE:
            continue
        left, wa, ta = _extension(words, text, wi - 1, ti - 1, -1, wi)
        right, wz, tz = _extension(words, text, wi + PIECE, ti + PIECE, 1, len(words) - wi - PIECE)
        reached[ti - wi] = tz
        if left + PIECE + right >= LEAST_RUN:
            out.append((wa + 1, wz, ta + 1, tz, left + PIECE + right))
    return out


def _part(words: list[int], found: list[Run], text: list[int]) -> float:
    chain = _chain(found)
    got = sum(x[4] for x in chain)
    for k, (a, z, start, end, _) in enumerate(chain):
        if k + 1 == len(chain) or chain[k + 1][0] != z:
            got += _extension(words, text, z, end, 1, (chain[k + 1][0] if k + 1 < len(chain) else len(words)) - z)[0]
        if k == 0 or chain[k - 1][1] != a:
            got += _extension(words, text, a - 1, start - 1, -1, a - (chain[k - 1][1] if k else 0))[0]
    return min(1.0, got / len(words))


def search(ps: Passages, texts: list[str | None], least: float = LEAST_PART) -> list[tuple[int, int, float]]:
    """(text number, passage number, part found) wherever a text holds at least `least` of a passage."""
    if not ps.ids:
        return []
    get, pad = ps.number.get, ps.widest + PIECES
    parts, lengths = [], []
    for text in texts:
        ids = [get(w, 0) for w in words_of(text, ps.number)]
        parts += ids
        parts += [0] * pad  # keeps windows and pieces from reaching into the next text
        lengths.append(len(ids) + pad)
    flat = np.array([0] * pad + parts, ps.kind)
    starts = pad + np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    doc_of = lambda at: np.searchsorted(starts, at, side="right") - 1
    out = []
    for n, codes, exact, numbers in ps.short:  # found whole or not at all
        at, k = ps._lookup(flat, n, codes, exact)
        out += [(d, p, 1.0) for d, p in {(int(d), int(p)) for d, p in zip(doc_of(at), numbers[k])}]
    where, piece = ps.hits(flat)
    if not len(where):
        return out
    reps = ps.offset[piece + 1] - ps.offset[piece]
    if reps.sum() > MOST_HITS and len(texts) > 1:
        half = len(texts) // 2
        return search(ps, texts[:half], least) + [(d + half, p, part) for d, p, part in search(ps, texts[half:], least)]
    idx = np.repeat(ps.offset[piece] - np.concatenate([[0], np.cumsum(reps)[:-1]]), reps) + np.arange(reps.sum())
    block, hit_at, place = ps.hit_block[idx], ps.hit_at[idx], np.repeat(where, reps)
    begin = place - hit_at  # where the block would begin
    doc = doc_of(place)
    # a few places apart is the same occurrence: one window takes them all
    slot = (doc * (len(ps.size) + 1) + block) * (int(starts[-1]) // PIECES + 2) + (begin // PIECES)
    _, first = np.unique(slot, return_index=True)
    slack = PIECES + PIECE // 2
    found: dict[tuple[int, int], dict[tuple[int, int], Run]] = defaultdict(dict)
    verified: set[tuple[int, int]] = set()
    for lo in range(0, len(first), 20_000):
        pick = first[lo : lo + 20_000]
        b, s, d = block[pick], begin[pick], doc[pick]
        left = np.maximum(s - slack, 0)
        span = left[:, None] + np.arange(ps.widest + 2 * slack)[None, :]
        inside = span < (s + ps.size[b] + slack)[:, None]
        window = np.where(inside, flat[np.minimum(span, len(flat) - 1)], ps.kind(0))
        dist, end = myers_batch(ps.pattern[b], ps.size[b], window)
        budget = ps.size[b] // PIECE - 1
        for k in np.flatnonzero(dist <= budget):
            e = int(left[k] + end[k] - starts[d[k]])
            size, n, at = int(ps.size[b[k]]), int(dist[k]), int(ps.begin[b[k]])
            verified.add((int(d[k]), int(b[k])))
            found[int(d[k]), int(ps.passage[b[k]])].setdefault((int(b[k]), e), (at, at + size, e - size, e, size - n))
    # pieces of blocks that are not there as a whole, wherever these could still make up the part together
    seen = np.unique(np.array([d * (len(ps.size) + 1) + b for d, b in verified], np.int64))
    pick = np.flatnonzero(~np.isin(doc * (len(ps.size) + 1) + block, seen)) if len(seen) else np.arange(len(doc))
    pick = pick[_may_run(ps, flat, ps.passage[block[pick]], ps.begin[block[pick]] + hit_at[pick], place[pick])]
    loose: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    for d, p, w, t in zip(doc[pick].tolist(), ps.passage[block[pick]].tolist(), (ps.begin[block[pick]] + hit_at[pick]).tolist(), (place[pick] - starts[doc[pick]]).tolist()):
        loose[d, p].append((w, t))
    texts_ids: dict[int, list[int]] = {}
    for d, p in found.keys() | loose.keys():
        runs = list(found[d, p].values()) if (d, p) in found else []
        n = len(ps.ids[p])
        if not runs and 2 * BLOCK * len(loose[d, p]) < least * n:  # a piece reaches no further than its neighbours' blocks
            continue
        if d not in texts_ids:
            texts_ids[d] = flat[starts[d] : starts[d + 1] - pad].tolist()
        words = ps.ids[p].tolist()
        part = _part(words, runs + _runs(words, texts_ids[d], loose.get((d, p), [])), texts_ids[d])
        if part >= least:
            out.append((d, p, part))
    return out


_READY: dict = {}


def _finder(name: str, shared, doc_type: pa.DataType, item_type: pa.DataType, least: float):
    def run(batches):
        ps = _READY.get(name)
        if ps is None:  # once per Python worker
            _READY.clear()
            ps = _READY[name] = Passages(shared.value)
        for batch in batches:
            docs, items, parts = [], [], []
            for lo in range(0, batch.num_rows, CHUNK):
                keys = batch.column(0).slice(lo, CHUNK).to_pylist()
                for d, p, part in search(ps, batch.column(1).slice(lo, CHUNK).to_pylist(), least):
                    for item in ps.keys[p]:
                        docs.append(keys[d])
                        items.append(item)
                        parts.append(part)
            yield pa.RecordBatch.from_arrays([pa.array(docs, doc_type), pa.array(items, item_type), pa.array(parts, pa.float64())], ["d", "i", "part"])

    return run


def find_leaks(
    docs: DataFrame, doc_key: str, text: str, items: DataFrame, item_key: str, passage: str, least: float = LEAST_PART, items_per_block: int = ITEMS_PER_BLOCK
) -> DataFrame:
    """(doc_key, item_key, part): documents that hold at least `least` of an item's words in their order.

    All items that share a passage are reported. Null and empty texts hold nothing, and passages without a letter or
    digit occur nowhere; passages of fewer than eight words must occur whole. Documents or items without a key are left
    out; repeated rows give their pair once, with the larger part. Empty tables give an empty result. Other columns are
    ignored, whatever their names. Where passages need several blocks, each block's pairs are written before the next.
    """
    spark = docs.sparkSession
    d = docs.where(F.col(doc_key).isNotNull()).select(F.col(doc_key).alias("d"), F.col(text).cast("string").alias("t"))
    i = items.where(F.col(item_key).isNotNull() & F.col(passage).isNotNull()).select(F.col(item_key).alias("i"), F.col(passage).cast("string").alias("p"))
    keyed = i.select("i", F.sha2("p", 256).alias("k"), "p")
    passages = keyed.groupBy("k").agg(F.first("p").alias("p"))
    n, chars = passages.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("p")), F.lit(0))).first()
    n_blocks = max(1, -(-n // items_per_block), -(-chars // CHARACTERS_PER_BLOCK))
    doc_type = to_arrow_type(d.schema["d"].dataType)
    schema = f"d {dict(d.dtypes)['d']}, i string, part double"
    found = []
    for b in range(n_blocks):  # one bounded block on the driver at a time
        rows = passages.where(F.pmod(F.xxhash64("k"), F.lit(n_blocks)) == b).collect()
        shared = spark.sparkContext.broadcast([(r["k"], r["p"]) for r in rows])
        pairs = d.mapInArrow(_finder(uuid.uuid4().hex, shared, doc_type, pa.string(), least), schema)
        if n_blocks > 1:
            pairs = materialise(pairs, "leaks")
            shared.destroy()
        found.append(pairs)
    pairs = functools.reduce(DataFrame.unionByName, found).groupBy("d", "i").agg(F.max("part").alias("part"))
    pairs = pairs.join(keyed.select("k", F.col("i").alias("_item")).distinct(), F.col("i") == F.col("k"))
    return pairs.groupBy(F.col("d").alias(doc_key), F.col("_item").alias(item_key)).agg(F.max("part").alias("part"))
