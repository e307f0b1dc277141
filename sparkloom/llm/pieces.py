"""SentencePiece encoding with seeded merge dropout, and lossless decoding.

Merges are taken from an agenda by rank and then from left to right, as the model's own encoder does, but each candidate
that comes up is skipped if a keyed hash of its text, unit, merge and place falls below the dropout rate, so every
occurrence of a word draws anew. Units between spaces and line ends can't merge with each other. What is kept of a unit is
its agenda without dropout: an occurrence that skips none of those merges has that segmentation, and all others run
their own agendas, many at once in numpy.
"""

from __future__ import annotations

import heapq
import re
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import bound_batches, give_back, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SEED, RATE = 20240, 0.1
SPACE = "▁"
#: Stands for a SPACE character of the text itself, which is encoded as bytes; a text can't hold a lone surrogate.
LITERAL = "\ud800"
UNIT = re.compile(f"{SPACE}*[^{SPACE}{LITERAL}\n]+|{SPACE}+|[{LITERAL}\n]")
NEVER = 1 << 62
MASK = (1 << 64) - 1
SHORT = 48  # symbols; longer units take a heap
KEPT = 1 << 17  # units kept by a worker; beyond, the half used least goes
TAKEN = 1 << 20  # characters split at a time
AT_ONCE = 1 << 16  # units segmented at a time
_RANK, _AT, _OUT = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9


def ragged(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begins[0], begins[0] + 1, ... for sizes[0] places, then the same for the next, and so on."""
    ends = np.cumsum(sizes)
    return np.repeat(begins - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Rows:
    """Rows of various sizes, end to end in one growing array."""

    def __init__(self, dtype):
        self.flat, self.used = np.zeros(1 << 12, dtype), 0
        self.sizes, self.begins, self.n = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64), 0

    def extend(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while self.n + len(sizes) > len(self.sizes):
            self.sizes, self.begins = (np.concatenate((x, np.zeros_like(x))) for x in (self.sizes, self.begins))
        self.flat[self.used : self.used + len(flat)] = flat
        self.sizes[self.n : self.n + len(sizes)] = sizes
        self.begins[self.n : self.n + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.used, self.n = self.used + len(flat), self.n + len(sizes)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.sizes[rows]
        return self.flat[ragged(self.begins[rows], sizes)], sizes

    def kept(self, rows: np.ndarray) -> Rows:
        out = Rows(self.flat.dtype)
        out.extend(*self.take(rows))
        return out


class Numbers(dict):
    """Units by number, as they come up; ``new`` lists those that were numbered since it was emptied."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        n = self[unit] = len(self)
        self.new.append(unit)
        return n


class PieceEncoder:
    """One model, seed and dropout rate. ``rate`` 0 gives the model's own segmentation."""

    def __init__(self, model: str = MODEL, seed: int = SEED, rate: float = RATE, kept: int = KEPT):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        size = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.ids = {pieces[i]: i for i in plain}
        order = sorted(plain, key=lambda i: -sp.get_score(i))
        self.rank = {pieces[i]: r for r, i in enumerate(order) if len(pieces[i]) > 1}
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bytes_of = [b""] * size
        for i in plain:
            self.bytes_of[i] = pieces[i].replace(SPACE, " ").encode("utf-8")
        for b, i in enumerate(self.byte):
            self.bytes_of[i] = bytes([b])
        self.seed, self.limit, self.most = seed, int(rate * (1 << 32)), kept
        # every pair of symbols that makes up a piece, in a table found by hash: the pair as one number; the piece's rank and id
        pairs = {self.ids[p[:i]] << 32 | self.ids[p[i:]]: r << 32 | self.ids[p] for p, r in self.rank.items() for i in range(1, len(p)) if p[:i] in self.ids and p[i:] in self.ids}
        self.slots = max(16, (2 * len(pairs)).bit_length())
        self.pairs, self.merged = np.full(1 << self.slots, -1, np.int64), np.full(1 << self.slots, NEVER, np.int64)
        self.probes = self._fill(np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int64))
        # ids of characters by code point, -1 for those that aren't pieces
        self.char_ids = np.full(0x110000, -1, np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.char_ids[ord(p)] = i
        self._forget()

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        return (pairs.view(np.uint64) * np.uint64(_RANK) >> np.uint64(64 - self.slots)).astype(np.int64)

    def _fill(self, pairs: np.ndarray, merged: np.ndarray) -> int:
        slot, probes, left = self._slot(pairs), 0, np.arange(len(pairs))
        while len(left):
            probes += 1
            free = left[self.pairs[slot[left]] == -1]
            self.pairs[slot[free]], self.merged[slot[free]] = pairs[free], merged[free]  # of several the last stays
            left = left[self.pairs[slot[left]] != pairs[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.slots) - 1)
        return probes

    def _candidates(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank and id (rank << 32 | id) of what each pair of symbols merges to; NEVER where it doesn't."""
        want = a.astype(np.int64) << 32 | b
        want[(a < 0) | (b < 0)] = -2
        slot = self._slot(want)
        out = np.where(self.pairs[slot] == want, self.merged[slot], NEVER)
        open_ = np.flatnonzero((self.pairs[slot] != want) & (self.pairs[slot] != -1) & (want >= 0))
        for p in range(1, self.probes):
            if not len(open_):
                break
            s = (slot[open_] + p) & ((1 << self.slots) - 1)
            hit = self.pairs[s] == want[open_]
            out[open_[hit]] = self.merged[s[hit]]
            open_ = open_[~hit & (self.pairs[s] != -1)]
        return out

    def _skips(self, key: int, rank: int, at: int) -> bool:
        h = ((key ^ (rank * _RANK) ^ (at * _AT)) * _OUT) & MASK
        return (h ^ (h >> 31)) & 0xFFFFFFFF < self.limit

    def _skip_many(self, keys: np.ndarray, ranks: np.ndarray, at: np.ndarray) -> np.ndarray:
        h = (keys ^ (ranks.astype(np.uint64) * np.uint64(_RANK)) ^ (at.astype(np.uint64) * np.uint64(_AT))) * np.uint64(_OUT)
        return ((h ^ (h >> np.uint64(31))) & np.uint64(0xFFFFFFFF)).astype(np.int64) < self.limit

    def unit_keys(self, text_keys: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The dropout keys of units: of the text's hash and the unit's place in it."""
        h = (text_keys.astype(np.uint64) ^ (places.astype(np.uint64) * np.uint64(_AT))) * np.uint64(_RANK)
        return h ^ (h >> np.uint64(29))

    def text_key(self, text: str) -> int:
        return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), self.seed)

    def segment(self, unit: str, key: int) -> list[str]:
        """The unit's pieces under one key."""
        if len(unit) > SHORT:
            return self._segment_long(unit, key)
        syms, at = list(unit), list(range(len(unit)))
        get, skips = self.rank.get, self._skips
        ranks = [get(a + b, NEVER) for a, b in zip(syms, syms[1:])]
        while ranks:
            best = min(ranks)
            if best == NEVER:
                break
            i = ranks.index(best)
            if self.limit and skips(key, best, at[i]):
                ranks[i] = NEVER
                continue
            syms[i] += syms[i + 1]
            del syms[i + 1], at[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(syms[i - 1] + syms[i], NEVER)
            if i < len(ranks):
                ranks[i] = get(syms[i] + syms[i + 1], NEVER)
        return syms

    def _segment_long(self, unit: str, key: int) -> list[str]:
        n = len(unit)
        syms: list[str | None] = list(unit)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda: list[tuple[int, int, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n:
                both = syms[i] + syms[j]
                r = self.rank.get(both)
                if r is not None:
                    heapq.heappush(agenda, (r, i, j, both))

        for i in range(n - 1):
            offer(i)
        while agenda:
            r, i, j, both = heapq.heappop(agenda)
            if syms[i] is None or after[i] != j or syms[i] + syms[j] != both:
                continue  # one of the two has merged meanwhile
            if self.limit and self._skips(key, r, i):
                continue
            syms[i], syms[j] = both, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [s for s in syms if s is not None]

    def segment_many(self, numbers: np.ndarray, keys: np.ndarray | None, events: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many kept units of SHORT symbols at most, end to end, and how many each has; no ``keys``: without dropout.

        All agendas advance together, one candidate of each unit at a time. ``events`` is given (unit's index, rank, place)
        of the candidates that come up.
        """
        if not len(numbers):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        sizes, begins = self.codes.sizes[numbers], self.codes.begins[numbers]
        order = np.argsort(sizes, kind="stable")
        found, counts = [], np.zeros(len(numbers), np.int64)
        for a in range(0, len(order), 4096):
            rows = order[a : a + 4096]
            columns = np.arange(int(sizes[rows].max()) + 1)
            # -1: a symbol that isn't a piece, -2: none; the last column is always none
            there = columns < sizes[rows][:, None]
            syms = np.where(there, self.codes.flat[np.minimum(begins[rows][:, None] + columns, self.codes.used - 1)], -2)
            syms, at = self._merge_all(syms, None if keys is None else keys[rows], None if events is None else (rows, events))
            ids, counts[rows] = self._flat(syms, at, numbers[rows] if (syms == -1).any() else None)
            found.append(ids)
        # from the order of length back to that of the units
        flat = np.concatenate(found)
        begins = np.empty(len(numbers), np.int64)
        begins[order] = np.cumsum(counts[order]) - counts[order]
        return flat[ragged(begins, counts)], counts

    def _merge_all(self, syms: np.ndarray, keys: np.ndarray | None, events: tuple | None) -> tuple[np.ndarray, np.ndarray]:
        n, width = syms.shape
        columns = np.arange(width)
        at = np.tile(columns.astype(np.int8), (n, 1))
        done_syms, done_at = syms.copy(), at.copy()
        cand = np.full((n, width), NEVER, np.int64)
        cand[:, :-1] = self._candidates(syms[:, :-1].ravel(), syms[:, 1:].ravel()).reshape(n, -1)
        left = np.arange(n)
        while len(left):
            row = np.arange(len(left))
            i = cand.argmin(1)
            best = cand[row, i]
            over = best == NEVER
            if 3 * over.sum() >= len(left):  # finished rows are put aside once they are many
                done_syms[left[over]], done_at[left[over]] = syms[over], at[over]
                left, syms, at, cand = (x[~over] for x in (left, syms, at, cand))
                keys = None if keys is None else keys[~over]
                continue
            if events is not None:
                events[1].append((events[0][left[~over]], (best >> 32)[~over], at[row, i][~over]))
            idle = over
            if keys is not None:
                skip = self._skip_many(keys, best >> 32, at[row, i])
                cand[row[skip], i[skip]] = NEVER
                idle = over | skip
            # the symbol to the right of a merge goes and all behind it move up; rows that are idle stay
            m, j = row[~idle], i[~idle]
            syms[m, j] = best[m] & 0xFFFFFFFF
            behind = columns[:-1] >= np.where(idle, width, i)[:, None]
            np.copyto(cand[:, :-1], cand[:, 1:].copy(), where=behind)
            behind[:, :-1] = behind[:, :-1] & (columns[:-2] != np.where(idle, width, i)[:, None])
            np.copyto(syms[:, :-1], syms[:, 1:].copy(), where=behind)
            np.copyto(at[:, :-1], at[:, 1:].copy(), where=behind)
            cand[m, j] = self._candidates(syms[m, j], syms[m, np.minimum(j + 1, width - 1)])
            some = j > 0
            m, j = m[some], j[some] - 1
            cand[m, j] = self._candidates(syms[m, j], syms[m, j + 1])
        return done_syms, done_at

    def _flat(self, syms: np.ndarray, at: np.ndarray, numbers: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        if numbers is None:
            there = syms >= 0
            return syms[there].astype(np.int32), there.sum(1)
        rows = []
        for u, ids, places in zip(numbers.tolist(), syms.tolist(), at.tolist()):
            rows.append([y for x, p in zip(ids, places) if x != -2 for y in ([x] if x >= 0 else self._bytes(self.names[u][p]))])
        return np.array(list(chain.from_iterable(rows)), np.int32), np.array([len(r) for r in rows])

    def _bytes(self, symbol: str) -> list[int]:
        return [self.byte[b] for b in (SPACE if symbol == LITERAL else symbol).encode("utf-8", "surrogatepass")]

    def _ids_of(self, unit: str, key: int) -> list[int]:
        out: list[int] = []
        for s in self.segment(unit, key):
            x = self.ids.get(s)
            out += self._bytes(s) if x is None else [x]
        return out

    def number(self, units: list[str]) -> np.ndarray:
        """The units' numbers; new ones are kept with their agendas without dropout."""
        out = np.fromiter(map(self.numbers.__getitem__, units), np.int64, len(units))
        new = self.numbers.new
        if new:
            first, self.numbers.new = len(self.names), []
            self.names += new
            short = [u if len(u) <= SHORT else "" for u in new]
            points = np.frombuffer("".join(short).encode("utf-32-le", "surrogatepass"), np.uint32)
            self.codes.extend(self.char_ids[points], np.array([len(u) for u in short], np.int64))
            events: list = []
            self.plain.extend(*self.segment_many(np.arange(first, first + len(new)), None, events if self.limit else None))
            which, ranks, at = (np.concatenate([e[k] for e in events]) if events else np.zeros(0, np.int64) for k in range(3))
            order = np.argsort(which, kind="stable")
            self.agendas.extend((ranks << 8 | at)[order], np.bincount(which, minlength=len(new)))
        return out

    def encode_units(self, units: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units under their keys, end to end, and how many each unit has."""
        numbers = self.number(units)
        ids, sizes = self.plain.take(numbers)
        drops = np.zeros(len(units), bool)
        if self.limit:
            agendas, n = self.agendas.take(numbers)
            skip = self._skip_many(np.repeat(keys, n), agendas >> 8, agendas & 0xFF)
            some = n > 0
            drops[some] = np.logical_or.reduceat(skip, (np.cumsum(n) - n)[some]) if some.any() else False
        own, own_sizes = self.segment_many(numbers[drops], keys[drops])
        long = [i for i, u in enumerate(units) if len(u) > SHORT] if self.long_seen(numbers) else []
        others = [self._ids_of(units[i], int(keys[i])) for i in long]
        if drops.any() or long:
            # own segmentations behind the plain ones, then all gathered in order
            begins, n = np.cumsum(sizes) - sizes, len(ids)
            begins[drops], sizes[drops] = n + np.cumsum(own_sizes) - own_sizes, own_sizes
            ids = np.concatenate((ids, own, np.array(list(chain.from_iterable(others)), np.int32)))
            n += len(own)
            for i, x in zip(long, others):
                begins[i], sizes[i] = n, len(x)
                n += len(x)
            ids = ids[ragged(begins, sizes)]
        self._age(numbers)
        return ids, sizes

    def long_seen(self, numbers: np.ndarray) -> bool:
        return bool((self.codes.sizes[numbers] == 0).any())

    def _age(self, numbers: np.ndarray) -> None:
        n = len(self.names)
        if n > len(self.hits):
            self.hits = np.concatenate((self.hits, np.zeros(max(n, len(self.hits)), np.int64)))
        self.hits[:n] += np.bincount(numbers, minlength=n)
        if n > self.most or any(len(u) > SHORT for u in self.names[self.aged :]):
            # the units used most stay, long ones never do
            weight = np.where(self.codes.sizes[:n] > 0, self.hits[:n], -1)
            stay = np.sort(np.argsort(-weight, kind="stable")[: self.most // 2 if n > self.most else n])
            stay = stay[weight[stay] >= 0]
            self.names = [self.names[i] for i in stay.tolist()]
            self.codes, self.plain, self.agendas = (x.kept(stay) for x in (self.codes, self.plain, self.agendas))
            self.hits = self.hits[stay] // 2
            self.numbers = Numbers()
            self.numbers.update(zip(self.names, range(len(self.names))))
        self.aged = len(self.names)

    def _forget(self) -> None:
        self.numbers, self.names, self.aged = Numbers(), [], 0
        self.hits = np.zeros(0, np.int64)
        self.codes, self.plain, self.agendas = Rows(np.int32), Rows(np.int32), Rows(np.int64)

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_batch([text])[0]

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of whole texts; none for null or empty. Equal texts have equal ids under one seed."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        units: list[str] = []
        jobs: list[tuple[int, int, int, int]] = []  # text, its key, the first unit's place in it, units

        def flush() -> None:
            if not units:
                return
            counts = np.array([j[3] for j in jobs])
            places = ragged(np.array([j[2] for j in jobs]), counts)
            ids, sizes = self.encode_units(units, self.unit_keys(np.repeat(np.array([j[1] for j in jobs], np.uint64), counts), places))
            ends = np.cumsum(sizes)[np.cumsum(counts) - 1]
            for (i, *_), x in zip(jobs, np.split(ids, ends[:-1])):
                out[i].append(x)
            units.clear()
            jobs.clear()

        for i, text in enumerate(texts):
            if not text:
                continue
            key, place = self.text_key(text), 0
            for part in parts_of(SPACE + text.replace(SPACE, LITERAL).replace(" ", SPACE)):
                found = UNIT.findall(part)
                jobs.append((i, key, place, len(found)))
                place += len(found)
                units += found
                if len(units) > AT_ONCE:
                    flush()
        flush()
        return [np.concatenate(x) if x else np.zeros(0, np.int32) for x in out]

    def decode(self, ids) -> str:
        """The text that the ids came from."""
        data = b"".join(map(self.bytes_of.__getitem__, ids))
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "surrogatepass")


def parts_of(text: str):
    """The text in parts of about TAKEN characters, cut where a unit begins with SPACE."""
    a = 0
    while len(text) - a > TAKEN:
        cut = text.rfind(SPACE, a + 1, a + TAKEN)
        while cut > a and text[cut - 1] == SPACE:
            cut -= 1
        if cut <= a:  # no unit begins with SPACE there
            cut = a + TAKEN
            while cut < len(text) and not (text[cut] == SPACE and text[cut - 1] != SPACE):
                cut += 1
        yield text[a:cut]
        a = cut
    yield text[a:]


@cache
def encoder(model: str, seed: int, rate: float) -> PieceEncoder:
    return PieceEncoder(model, seed, rate)


def encode_pieces(docs: DataFrame, model: str = MODEL, seed: int = SEED, rate: float = RATE) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens and lossless of every row of docs(doc_id, text, lang, source).

    ids segment the whole text with merge dropout under the seed; each occurrence of a unit draws by the whole text's hash
    and the unit's place, so equal texts have equal ids under one seed and another seed, say one for each epoch, gives other
    segmentations. ``lossless`` says that decoding them gave the text again. Null and empty texts have no ids and n_tokens 0.
    Null ids, repeated rows and further columns are allowed; the latter are ignored. An empty table gives an empty result.
    ``model`` is a path that every executor can read.
    """
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    bound_batches(docs.sparkSession)
    dtype = dict(rows.dtypes)["doc_id"]

    def run(batches):
        enc = encoder(model, seed, rate)
        for batch in batches:
            for a in range(0, batch.num_rows, 128):
                part = batch.slice(a, 128)
                texts = part.column("text").to_pylist()
                ids = enc.encode_batch(texts)
                same = [enc.decode(x.tolist()) == (t or "") for x, t in zip(ids, texts)]
                offsets = np.cumsum([0, *map(len, ids)], dtype=np.int64)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
                cols = [part.column(c) for c in ("doc_id", "lang", "source")] + [lists, pa.array(np.diff(offsets)), pa.array(same)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "lang", "source", "ids", "n_tokens", "lossless"])
        enc._forget()
        give_back()

    return rows.mapInArrow(run, f"doc_id {dtype}, lang string, source string, ids array<int>, n_tokens long, lossless boolean")


def decode_pieces(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text of every row of encoded(doc_id, ids). Null ids decode to an empty text; an empty table gives an empty result."""
    dtype = dict(encoded.dtypes)["doc_id"]

    def run(batches):
        enc = encoder(model, SEED, 0.0)
        for batch in batches:
            texts = [enc.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {dtype}, text string")


def op4_pieces(spark, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents"))
