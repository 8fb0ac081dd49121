"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text is normalised as such a vocabulary asks (a blank put before it, blanks
written as U+2581), and cut wherever no piece of the vocabulary holds the two
neighbouring characters side by side: no merge can cross such a place, so the
cuts change nothing. Each part starts as its characters; an agenda holds the
adjacent pairs that form a piece, best score first and leftmost among equals;
the first one is merged and its new neighbours enter the agenda, until none is
left. Characters that are no piece become the pieces of their UTF-8 bytes. The
agenda of a long part is a heap; those of many short ones are rows of a matrix
of scores, of each of which the best pair is merged in every step.

A block of texts is first cut at the same places as far as single bytes show
them, by one table look-up for each pair of neighbouring bytes; of the words that
result, each distinct one is merged once a block, and a task remembers those of
earlier blocks, in two generations of ``REMEMBERED`` words.

Every Arrow batch is checked against the ``sentencepiece`` library: each word
that the task has to encode, and one whole text of the batch, is encoded by
both, and a difference is an error; with ``check="texts"`` all whole texts are.
Decoding is the library's, in whole batches.

Edge cases: a null or empty text has the end id alone and decodes to the empty
text; texts may be of any length and may hold one part of any length, as the
agenda takes n log n steps; U+2581 in a text decodes to a blank, as it does in
the library; repeated rows give repeated rows; a null doc_id stays null; an
empty table gives an empty result; extra columns of any name are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import kernels, shared

#: What stands for a blank in pieces.
BLANK = "▁"
#: Words of a generation that a task remembers, and characters of the longest word or part that counts as short.
REMEMBERED, SHORT = 250_000, 48
#: Code points under this are looked up as a matrix of neighbours, others in a sorted list.
NEAR = 512
NEVER = float("inf")
#: Parts whose agendas advance together.
IN_STEP = 50_000
#: Bytes of text whose distinct words are found together.
BLOCK_BYTES = 2_000_000
_BLANK, _NOTHING = (pa.scalar(x, pa.large_string()) for x in (" ", ""))


class Codec:
    """A merge-type SentencePiece vocabulary."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        bare = sentencepiece_model_pb2.ModelProto.FromString(self.library.serialized_model_proto())
        bare.normalizer_spec.add_dummy_prefix = False
        self.parts = sentencepiece.SentencePieceProcessor(model_proto=bare.SerializeToString())  # the same, for parts of texts
        lib, every = self.library, range(self.library.vocab_size())
        plain = [i for i in every if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))]
        self.id_of = {lib.id_to_piece(i): i for i in plain}
        self.cost = {lib.id_to_piece(i): -lib.get_score(i) for i in plain}
        self.piece = {i: p for p, i in self.id_of.items()}
        self.byte = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        sample = "  Aéﬁ Ａ b\t　x  "
        if lib.normalize(sample) != self.normalised(sample) or not all(map(lib.is_byte, self.byte)) or any(map(lib.is_unused, every)):
            raise ValueError("only vocabularies of merged pieces with byte pieces, without unused pieces, that change nothing but blanks")
        self.pairs = {p[k : k + 2] for p in self.id_of for k in range(len(p) - 1)}
        self.beside = np.zeros((NEAR + 1, NEAR + 1), bool)
        for a, b in map(lambda p: map(ord, p), self.pairs):
            if max(a, b) < NEAR:
                self.beside[a, b] = True
        self.far = np.array(sorted(ord(p[0]) << 21 | ord(p[1]) for p in self.pairs), np.uint64)
        #: The same by bytes, with a blank for itself: whether a piece may hold two bytes side by side. Those of 128 and more stand for any other.
        self.joined = np.zeros((256, 256), bool)
        self.joined[128:, 128:] = True
        for pair in self.pairs:
            a, b = (ord(" ") if c == BLANK else ord(c) for c in pair)
            self.joined[a if a < 128 else slice(128, None), b if b < 128 else slice(128, None)] = True
        #: Symbols are pieces, by id, and after them the other characters of pieces; a pair of symbols is one number.
        symbol = dict(self.id_of)
        for c in sorted({c for p in self.id_of for c in p} - set(symbol)):
            symbol[c] = lib.vocab_size() + len(symbol) - len(self.id_of)
        self.symbol = np.full(0x110000, -1, np.int32)
        for c in symbol:
            if len(c) == 1:
                self.symbol[ord(c)] = symbol[c]
        merges = [(symbol[p[:k]] << 32 | symbol[p[k:]], i) for p, i in self.id_of.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol]
        self.merge, self.into = (np.array(x, np.int64) for x in zip(*sorted(merges)))
        self.said = pa.array([str(i) for i in every], pa.large_string())
        self.score = np.append(np.array([self.cost.get(lib.id_to_piece(i), NEVER) for i in every]), NEVER)
        self.young: dict[bytes, tuple[bytes, str]] = {}
        self.old: dict[bytes, tuple[bytes, str]] = {}

    @staticmethod
    def normalised(text: str) -> str:
        return BLANK + text.replace(" ", BLANK) if text else ""

    def cuts(self, text: str) -> list[str]:
        """The parts of a normalised text that no merge crosses."""
        c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        low = np.minimum(c, NEAR)
        joined = self.beside[low[:-1], low[1:]]
        far = np.flatnonzero((low[:-1] == NEAR) | (low[1:] == NEAR))
        if len(far):
            pair = (c[far].astype(np.uint64) << np.uint64(21)) | c[far + 1]
            found = np.minimum(np.searchsorted(self.far, pair), len(self.far) - 1)
            joined[far] = self.far[found] == pair
        at = (np.flatnonzero(~joined) + 1).tolist()
        return [text[a:b] for a, b in zip([0, *at], [*at, len(text)])]

    def _merges(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What pairs of symbols merge into (-1 if into nothing), and the scores."""
        pair = np.where((left < 0) | (right < 0), -1, left.astype(np.int64) << 32 | right)
        at = np.minimum(np.searchsorted(self.merge, pair), len(self.merge) - 1)
        into = np.where(self.merge[at] == pair, self.into[at], -1)
        return into, self.score[into]

    def in_step(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of short parts (-1 for what is in no piece), one part after another, and how many each has."""
        size = np.array([len(p) for p in parts], np.int64)
        chars = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
        width = int(size.max(initial=1))
        inside = np.arange(width) < size[:, None]
        final = np.full((len(parts), width), -1, np.int32)
        final[inside] = self.symbol[chars]
        row, now, left = np.arange(len(parts)), final, size.copy()
        into, cost = self._merges(now[:, :-1], now[:, 1:])
        cost[~inside[:, 1:]] = NEVER
        while width > 1:
            best = cost.argmin(1)  # the leftmost among equals
            go = cost[np.arange(len(row)), best] < NEVER
            if not go.all():
                final[row[~go]] = now[~go]
                row, now, into, cost, best = row[go], now[go], into[go], cost[go], best[go]
            if not len(row):
                break
            r = np.arange(len(row))
            now[r, best] = into[r, best]
            left[row] -= 1
            # what stands after the pair moves one place to the left
            place = np.arange(width) + (np.arange(width) > best[:, None])
            now = np.take_along_axis(np.append(now, np.full((len(row), 1), -1, np.int32), 1), place, 1)
            gaps = np.full((len(row), 1), NEVER)
            place = np.arange(width - 1) + (np.arange(width - 1) > best[:, None])
            cost = np.take_along_axis(np.append(cost, gaps, 1), place, 1)
            into = np.take_along_axis(np.append(into, np.full((len(row), 1), -1), 1), place, 1)
            for at in (best - 1, best):
                ok = np.flatnonzero((at >= 0) & (at + 1 < left[row]))
                k = at[ok]
                into[ok, k], cost[ok, k] = self._merges(now[ok, k], now[ok, k + 1])
            ok = np.flatnonzero(best >= left[row] - 1)  # the merged symbol is the last now
            cost[ok, np.minimum(best[ok], width - 2)] = NEVER
        return final[np.arange(width) < left[:, None]], left

    def by_heap(self, part: str) -> list[str]:
        """The pieces of one part; its agenda is a heap of (score, left symbol, right symbol, characters)."""
        symbols, cost = list(part), self.cost
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(c, i, i + 1, 2) for i in range(n - 1) if (c := cost.get(part[i : i + 2])) is not None]
        heapq.heapify(agenda)

        def offer(i: int, j: int) -> None:
            pair = symbols[i] + symbols[j]
            if (c := cost.get(pair)) is not None:
                heapq.heappush(agenda, (c, i, j, len(pair)))

        while agenda:
            _, i, j, size = heapq.heappop(agenda)
            if not symbols[i] or not symbols[j] or len(symbols[i]) + len(symbols[j]) != size:
                continue  # one of both has been merged with another since
            symbols[i] += symbols[j]
            symbols[j] = ""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                offer(i, after[j])
            if before[i] >= 0:
                offer(before[i], i)
        return [s for s in symbols if s]

    def ids_of(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """The ids of normalised texts, as bytes of 32-bit integers, and their decimals joined by blanks."""
        parts = [(t,) if len(t) <= SHORT else self.cuts(t) for t in texts]
        short = sorted({p for x in parts for p in x if len(p) <= SHORT}, key=len)
        done: dict[str, tuple[bytes, str]] = {}
        for i in range(0, len(short), IN_STEP):
            some = short[i : i + IN_STEP]
            for a, b in zip(edges := np.searchsorted([len(p) for p in some], [0, 9, 17, SHORT + 1]).tolist(), edges[1:]):
                symbols, n = self.in_step(some[a:b])
                odd = (symbols < 0) | (symbols >= len(self.said))
                ends = np.append(0, np.cumsum(n))
                said = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends), self.said.take(pa.array(np.where(odd, 0, symbols)))), _BLANK).to_pylist()
                raw, at = symbols.tobytes(), (4 * ends).tolist()
                done.update(zip(some[a:b], zip([raw[x:y] for x, y in zip(at, at[1:])], said)))
                for k in np.unique(np.searchsorted(ends, np.flatnonzero(odd), "right") - 1).tolist():
                    done[some[a + k]] = self._with_bytes(some[a + k], symbols[ends[k] : ends[k + 1]].tolist())
        out = []
        for x in parts:
            got = [done.get(p) or self._with_bytes(p, [self.id_of.get(s, -1) for s in self.by_heap(p)]) for p in x]
            out.append(got[0] if len(got) == 1 else (b"".join(g[0] for g in got), " ".join(g[1] for g in got)))
        return out

    def _with_bytes(self, part: str, symbols: list[int]) -> tuple[bytes, str]:
        """The same of a part from its symbols: a character that is no piece becomes the pieces of its bytes."""
        out, at, known = [], 0, len(self.said)
        for s in symbols:
            if 0 <= s < known:
                out.append(s)
                at += len(self.piece[s])
            else:
                out += [self.byte[b] for b in part[at].encode()]
                at += 1
        return np.array(out, np.int32).tobytes(), " ".join(map(str, out))

    def encode(self, texts: pa.Array, new: dict[str, bytes] | None = None) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """The ids of large strings without nulls, one after another and without end ids; where each text's begin; their decimals.

        Words that were not remembered are put into ``new``, normalised, with their ids.
        """
        plain = pc.replace_substring(texts, BLANK, " ")  # which become the same
        plain = pc.if_else(pc.equal(pc.binary_length(plain), 0), plain, pc.binary_join_element_wise(_BLANK, plain, _NOTHING))
        data, off = kernels.raw(plain)
        start = np.ones(len(data), bool)
        start[1:] = ~self.joined[data[:-1], data[1:]]
        start[off[:-1][off[:-1] < len(data)]] = True
        at = np.flatnonzero(start)
        bounds = np.append(at, len(data)).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        found = self._remembered(words.dictionary.to_pylist(), new)
        which = words.indices.to_numpy()
        flat = np.frombuffer(b"".join(ids for ids, _ in found), np.int32)
        size = np.array([len(ids) // 4 for ids, _ in found], np.int64)
        n = size[which]
        ends = np.cumsum(n)
        begin = (np.cumsum(size) - size)[which] - (ends - n)
        ids = flat[np.repeat(begin, n) + np.arange(int(n.sum()))]
        rows = np.searchsorted(at, off)
        said = pa.array([x for _, x in found], pa.large_string()).take(words.indices)
        said = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(rows), said), _BLANK)
        return ids, np.concatenate([[0], ends])[rows], said

    def _remembered(self, words: list[bytes], new: dict[str, bytes] | None) -> list[tuple[bytes, str]]:
        """The ids of words, as bytes, and their decimals: remembered, or encoded now."""
        young, old = self.young, self.old
        found = [young.get(w) or old.get(w) for w in words]
        missing = [k for k, x in enumerate(found) if x is None]
        normal = [words[k].decode().replace(" ", BLANK) for k in missing]
        got = self.ids_of(normal)
        if new is not None:
            new.update(zip(normal, (ids for ids, _ in got)))
        for k, x in zip(missing, got):
            found[k] = x
        for w, x in zip(words, found):
            if len(w) <= SHORT:
                if len(young) >= REMEMBERED:
                    self.old, self.young = young, {}
                    young = self.young
                young[w] = x
        return found

    def confirm(self, parts: dict[str, bytes], texts: dict[str, bytes]) -> None:
        """Raise unless the library has the same ids for the normalised parts and for the whole texts."""
        for library, own in ((self.parts, parts), (self.library, texts)):
            if own:
                theirs = library.encode(list(own), num_threads=1)
                same = np.array_equal(np.fromiter(itertools.chain.from_iterable(theirs), np.int32), np.frombuffer(b"".join(own.values()), np.int32))
                if not same or list(map(len, theirs)) != [len(x) // 4 for x in own.values()]:
                    wrong = next(t for t, x in zip(own, theirs) if np.array(x, np.int32).tobytes() != own[t])
                    raise ValueError(f"the library encodes what begins {wrong[:50]!r} otherwise")


@functools.lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, model: str, check: str = "parts") -> DataFrame:
    """(doc_id, ids): every text's ids, the end id last. check: ``parts`` or ``texts``, see above."""

    @kernels.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, ids, _ in _encoded(batches, model, check):
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""

    @kernels.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = codec(model).library.decode(pa.array(batch.column(1)).fill_null([]).to_pylist(), num_threads=1) if len(batch) else []
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def _encoded(batches: Iterator[pa.RecordBatch], model: str, check: str) -> Iterator[tuple[pa.Array, list[list[int]], list[str]]]:
    """(doc_ids, ids with the end id, their decimals) by blocks of bounded bytes, checked batch by batch."""
    code = codec(model)
    end = code.library.eos_id()
    for batch in batches:
        doc_ids, text = batch.column(0).cast(pa.int64()), kernels.text_array(batch.column(1))
        for n, (i, j) in enumerate(kernels.blocks(text, BLOCK_BYTES)):
            new: dict[str, bytes] = {}
            flat, rows, said = code.encode(text[i:j], new)
            ids = [flat[a:b].tolist() for a, b in zip(rows[:-1], rows[1:])]
            whole = range(i, j) if check == "texts" else []
            if check != "texts" and n == 0:  # the shortest that is not empty
                chars = pc.utf8_length(text[i:j]).to_numpy()
                whole = [i + int(np.where(chars > 0, chars, chars.max(initial=0) + 1).argmin())]
            code.confirm(new, {text[k].as_py(): flat[rows[k - i] : rows[k - i + 1]].tobytes() for k in whole})
            yield doc_ids[i:j], [x + [end] for x in ids], [f"{x} {end}" if x else f"{end}" for x in said.to_pylist()]


def digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text: encoded, checked, decoded and digested where it lies."""

    @kernels.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, ids, said in _encoded(batches, model, "parts"):
            back = codec(model).library.decode(ids, num_threads=1)
            hexed = lambda texts: pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(list(map(len, ids)), pa.int64()), hexed(said), hexed(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark, sf_dir: str) -> DataFrame:
    return digests(shared.table(spark, sf_dir, "documents"), model_path())
