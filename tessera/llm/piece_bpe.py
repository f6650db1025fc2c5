"""SentencePiece BPE encoding by a score-ordered agenda of adjacent pairs."""

from __future__ import annotations

import hashlib
import heapq
import re
import string
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import forget, remembered
from tessera.llm.tokens import pieces_of

SPACE = "▁"
CACHE_ENTRIES = 600_000
MARKS = string.punctuation
CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*")


class PieceEncoder:
    """Encodes with the vocabulary of a merge-type (BPE) sentencepiece model.

    The agenda holds every adjacent pair of symbols whose concatenation is a
    piece, best score first and leftmost among equals; the best pair merges, and
    its new neighbours join the agenda. Symbols that are no piece at the end
    become byte pieces (or the unknown id, in a model without them).

    No piece continues over a space mark that follows another character, so a
    text falls into words that are encoded apart and remembered. The words that
    an Arrow batch brings anew are encoded by the library too, in one call, and
    compared; where the two differ, the library's ids hold and the documents of
    the batch are marked.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = sp = SentencePieceProcessor(model_file=path)
        self.score: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.bytes: dict[int, int] = {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
            elif sp.is_unused(i):
                raise ValueError("models with unused pieces need resegmentation, which isn't offered")
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                self.score[piece] = sp.get_score(i)
                self.ids[piece] = i
            if SPACE in piece.lstrip(SPACE):
                raise ValueError(f"piece {piece!r} spans words")
        self.unknown = sp.unk_id()
        self.shared = list(range(sp.get_piece_size()))  # one object for each id, whatever remembers it
        #: Marks that no piece holds behind a letter: nothing merges over that border.
        self.apart = {m for m in MARKS if not any(m in p[1:] and any(a.isalpha() and b == m for a, b in zip(p, p[1:])) for p in self.score)}
        self.known = [{}, {}]  # of words after a space mark, and of words at a line's start
        self.fresh: list[dict[str, tuple[list[int], str]]] = [{}, {}]
        self.joined: list[dict[str, tuple[list[int], str]]] = [{}, {}]  # of a checked word and its marks

    def agenda(self, text: str) -> list[int]:
        """The ids of a text whose spaces are marks already."""
        symbols, score = list(text), self.score
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if pair in score:
                heap.append((-score[pair], i, i + 1, pair))
        heapq.heapify(heap)
        while heap:
            _, left, right, pair = heapq.heappop(heap)
            # A symbol that has merged meanwhile makes the entry stale.
            if not symbols[left] or not symbols[right] or len(symbols[left]) + len(symbols[right]) != len(pair):
                continue
            symbols[left], symbols[right] = pair, ""
            after[left] = follows = after[right]
            if follows < n:
                before[follows] = left
                joined = pair + symbols[follows]
                if joined in score:
                    heapq.heappush(heap, (-score[joined], left, follows, joined))
            leads = before[left]
            if leads >= 0:
                joined = symbols[leads] + pair
                if joined in score:
                    heapq.heappush(heap, (-score[joined], leads, left, joined))
        out: list[int] = []
        for symbol in symbols:
            if symbol:
                found = self.ids.get(symbol)
                if found is not None:
                    out.append(found)
                elif self.bytes:
                    out.extend(self.bytes[b] for b in symbol.encode())
                else:
                    out.append(self.unknown)
        return out

    def _word(self, word: str, at_line: int) -> tuple[list[int], str]:
        found = self.known[at_line].get(word) or self.fresh[at_line].get(word) or self.joined[at_line].get(word)
        if found is None:
            letters = word.rstrip(MARKS)
            if len(letters) < len(word) and letters[-1:].isalpha() and word[len(letters)] in self.apart:
                stem, marks = self._word(letters, at_line), self._word(word[len(letters) :], 1)
                found = [*stem[0], *marks[0]], f"{stem[1]},{marks[1]}"
                if len(self.known[at_line]) < CACHE_ENTRIES and len(word) < 64:
                    self.joined[at_line][word] = found
                return found
            ids = [self.shared[i] for i in self.agenda(word if at_line else SPACE + word)]
            found = self.fresh[at_line][word] = ids, ",".join(map(str, ids))
        return found

    def _encode(self, text: str) -> tuple[list[int], str, bool]:
        """Ids, the ids as text, and whether the words' checks cover them."""
        if not text:
            return [], "", True
        if "  " in text or text[0] == " " or SPACE in text:
            ids = list(chain.from_iterable(self.agenda(x) for x in CHUNK.findall(SPACE + text.replace(" ", SPACE))))
            return ids, ",".join(map(str, ids)), False
        known, word = self.known[0], self._word
        line_feed = word("\n", 1)
        parts = []
        for i, line in enumerate(text.split("\n")):
            first, *rest = line.split(" ")
            if i:
                parts.append(line_feed)
                if first:
                    parts.append(word(first, 1))
            else:
                parts.append(word(first, 0))
            parts.extend([known.get(x) or word(x, 0) for x in rest])
        return list(chain.from_iterable([x[0] for x in parts])), ",".join([x[1] for x in parts]), True

    def _settle(self) -> bool:
        """Compare the batch's new words with the library; True if all agree."""
        agree = True
        for at_line, lead in ((0, ""), (1, "\n")):
            words = list(self.fresh[at_line])
            # A line's first word is encoded behind a line feed, whose two ids are then dropped.
            for word, ids in zip(words, self.library.encode([lead + w for w in words], num_threads=1) if words else [], strict=True):
                ids = ids[2:] if at_line else ids
                # A lone space mark: the library has no text that encodes to it alone.
                if ids != self.fresh[at_line][word][0] and word:
                    agree = False
                    self.fresh[at_line][word] = ids, ",".join(map(str, ids))
                if len(self.known[at_line]) < CACHE_ENTRIES and len(word) < 64:
                    self.known[at_line][word] = self.fresh[at_line][word]
            self.fresh[at_line] = {}
            if agree:
                self.known[at_line] |= self.joined[at_line]
            self.joined[at_line] = {}
        return agree

    def encode_batch(self, texts: list[str]) -> tuple[list[list[int]], list[str], list[bool]]:
        found = [self._encode(x) for x in texts]
        agree = self._settle()
        ids, joined, same = [], [], []
        for text, (own, as_text, covered) in zip(texts, found, strict=True):
            ok = agree
            if not (agree and covered):
                library = self.library.encode(text, num_threads=1)
                ok = own == library
                if not ok:
                    own, as_text = library, ",".join(map(str, library))
            ids.append(own)
            joined.append(as_text)
            same.append(ok)
        return ids, joined, same


_ENCODERS: dict[str, PieceEncoder] = remembered()


def piece_encoder(path: str) -> PieceEncoder:
    forget(_ENCODERS)
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("agenda_agrees", pa.bool_()), ("round_trip", pa.bool_()), ("ids", pa.list_(pa.int32()))])


def encode_pieces(docs: DataFrame, model: str, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: n_tokens, ids_sha256 (of the decimal ids joined
    by commas), decoded_sha256 (of the library's decode(ids)), agenda_agrees
    (the library gave the same ids), round_trip (the decoded text is the text),
    and ids, if `with_ids`.

    Whole texts, without begin or end ids. A null text counts as empty and has
    no ids; repeated rows come out each; other columns are ignored. There is no
    shuffle, and memory is bounded by a worker's word cache and one slice of a
    batch.
    """
    schema = SCHEMA if with_ids else pa.schema(list(SCHEMA)[:-1])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = piece_encoder(model)
        for batch in batches:
            for rows in pieces_of(batch):
                texts = rows.column(1).to_pylist()
                ids, joined, same = enc.encode_batch(texts)
                decoded = enc.library.decode(ids, num_threads=1) if ids else []
                columns = [
                    rows.column(0),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in joined]),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string()),
                    pa.array(same, pa.bool_()),
                    pa.array([x == y for x, y in zip(texts, decoded, strict=True)], pa.bool_()),
                ]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kinds = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, agenda_agrees boolean, round_trip boolean"
    return rows.mapInArrow(encode, kinds + ", ids array<int>" * with_ids)
