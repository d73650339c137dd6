"""Exact merge-type subword encoding by backtracking, and decoding.

The encoder runs in Python workers over Arrow batches; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewright.llm.texts import narrow

SPACE = "▁"  # stands for a space in pieces
CACHE_ENTRIES = 250_000  # remembered segments and pairs; they only save time


class Remembered(dict):
    """Values of a function of one argument; beyond ``entries`` they are computed anew each time."""

    def __init__(self, function, entries: int) -> None:
        super().__init__()
        self.function, self.entries = function, entries

    def __missing__(self, key):
        value = self.function(key)
        if len(self) < self.entries:
            self[key] = value
        return value


class PieceModel:
    """Vocabulary of a merge-type model with byte fallback, a space in front and no other normalization."""

    def __init__(self, proto: bytes) -> None:
        import ahocorasick
        import sentencepiece

        reader = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.rank: dict[str, float] = {}  # lower merges first
        self.ids: dict[str, int] = {}
        self.bytes: list[int] = [0] * 256
        self.strings: dict[int, bytes] = {}
        for i in range(reader.get_piece_size()):
            piece = reader.id_to_piece(i)
            if reader.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes[value] = i
                self.strings[i] = bytes([value])
            elif not (reader.is_control(i) or reader.is_unknown(i)):
                self.ids[piece] = i
                self.rank[piece] = -reader.get_score(i)
                self.strings[i] = piece.replace(SPACE, " ").encode()
        # A cut between two characters that meet inside no piece changes nothing. Two such cuts are used: in
        # front of a space mark that follows another character, and on both sides of characters outside the vocabulary.
        self.cut_at_space = not any(a != SPACE and b == SPACE for p in self.ids for a, b in zip(p, p[1:], strict=False))
        self.chars = {p for p in self.ids if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            self.automaton.add_word(piece, (len(piece) - 1, piece))
        self.automaton.make_automaton()
        self.histories: dict[str, tuple] = {}
        self.shorter = Remembered(self._shorter, len(self.ids))
        self.compatible = Remembered(self._compatible, CACHE_ENTRIES)

    def history(self, text: str) -> tuple[list[tuple[float, str, str]], list[str]]:
        """The model's own merging: always the best adjacent pair whose join is a piece, the leftmost of equals.

        Gives each step's rank with the first and last part before it, and the parts at the end.
        """
        known = self.histories.get(text)
        if known is not None:
            return known
        parts = list(text)
        rank = self.rank
        ranks = [rank.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
        steps = []
        while True:
            best, at = None, -1
            for i, r in enumerate(ranks):
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            steps.append((best, parts[0], parts[-1]))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at < len(ranks):
                ranks[at] = rank.get(parts[at] + parts[at + 1])
            if at > 0:
                ranks[at - 1] = rank.get(parts[at - 1] + parts[at])
        self.histories[text] = steps, parts  # asked for pieces only, so bounded by the vocabulary
        return steps, parts

    def reachable(self, piece: str) -> bool:
        return len(self.history(piece)[1]) == 1

    def _shorter(self, piece: str) -> str | None:
        """The longest piece that is a proper prefix."""
        return next((piece[:n] for n in range(len(piece) - 1, 0, -1) if piece[:n] in self.ids), None)

    def _compatible(self, pair: tuple[str, str]) -> bool:
        """True if both pieces can come out of merging and merging the two joined anew gives them again."""
        return self.reachable(pair[0]) and self.reachable(pair[1]) and self._stay_apart(*pair)

    def _stay_apart(self, first: str, second: str) -> bool:
        """No merge crosses the border of two pieces.

        Until one does, the steps are those of either piece alone, the better one first, so both histories
        are replayed and the pair at the border is compared with the next steps.
        """
        left, right = self.history(first)[0], self.history(second)[0]
        rank = self.rank
        i = j = 0
        while True:
            a, x = (left[i][0], left[i][2]) if i < len(left) else (None, first)
            b, y = (right[j][0], right[j][1]) if j < len(right) else (None, second)
            across = rank.get(x + y)
            # of equal ranks the leftmost goes first: a step of the left piece, the border, a step of the right one
            if across is not None and (a is None or across < a) and (b is None or across <= b):
                return False
            if a is None and b is None:
                return True
            if b is None or (a is not None and a <= b):
                i += 1
            else:
                j += 1

    def known_run(self, text: str) -> list[str]:
        """Pieces of a text whose characters all are pieces.

        A row of reachable pieces is the model's result exactly if all neighbors are compatible: merges inside a piece
        do not depend on the outside, and the first merge across a border would also happen in the
        joined pair. So the search takes the longest piece at each place, falls back to shorter ones, and marks
        places from which no way leads on; a marked place is never entered again, which keeps it linear.
        """
        size = len(text)
        longest: list[str | None] = [None] * size
        for end, (back, piece) in self.automaton.iter(text):
            longest[end - back] = piece  # ends ascend, so the longest is set last
        failed, any_failed = bytearray(size // 8 + 1), False  # one bit per place
        compatible, shorter = self.compatible, self.shorter
        result: list[str] = []
        place, piece, before = 0, longest[0], None
        while place < size:
            while piece is not None:
                if compatible[before, piece] if before is not None else self.reachable(piece):
                    end = place + len(piece)
                    if not (any_failed and failed[end >> 3] >> (end & 7) & 1):
                        break
                piece = shorter[piece]
            if piece is None:
                failed[place >> 3] |= 1 << (place & 7)
                any_failed = True
                piece = result.pop()  # the text has an encoding, so there is a piece to take back
                place -= len(piece)
                before = result[-1] if result else None
                piece = shorter[piece]
                continue
            result.append(piece)
            place, before = end, piece
            piece = longest[place] if place < size else None
        return result

    def segment(self, text: str) -> list[int]:
        """Ids of a segment; characters outside the vocabulary become bytes."""
        if self.chars.issuperset(text):
            return [self.ids[p] for p in self.known_run(text)]
        out: list[int] = []
        run: list[str] = []
        ids = self.ids

        def close() -> None:
            if run:
                out.extend(ids[p] for p in self.known_run("".join(run)))
                run.clear()

        for char in text:
            if char in ids:
                run.append(char)
            else:
                close()
                out.extend(self.bytes[b] for b in char.encode("utf-8", "surrogatepass"))
        close()
        return out

    def segments(self, text: str) -> list[str]:
        """Cut a text where no piece can cross."""
        if not text:
            return []
        marked = SPACE + text.replace(" ", SPACE)
        if not self.cut_at_space:
            return [marked]
        return re.findall(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+" if "\n" not in self.ids else f"{SPACE}+[^{SPACE}]*", marked)

    def encode(self, text: str) -> list[int]:
        return [i for part in self.segments(text) for i in self.segment(part)]

    def decode(self, ids: list[int]) -> str:
        """The text of the ids; the space in front goes, bytes that form no character become U+FFFD."""
        joined = b"".join(map(self.strings.__getitem__, ids))
        return joined.decode("utf-8", "replace").removeprefix(" ")


def encode_partitions(proto: bytes):
    """Worker function: (doc_id, text) -> doc_id, n_tokens, ids_text, decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel(proto)

        def learn(part: str) -> tuple[str, int, bytes]:
            ids = model.segment(part)
            return ",".join(map(str, ids)), len(ids), b"".join(map(model.strings.__getitem__, ids))

        known = Remembered(learn, CACHE_ENTRIES)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                piece = batch.slice(start, 256)
                counts, ids_texts, decoded = [], [], []
                for text in piece.column(1).to_pylist():
                    found = [known[part] for part in model.segments(text or "")]
                    counts.append(sum(n for _, n, _ in found))
                    ids_texts.append(",".join([ids for ids, _, _ in found]))
                    joined = b"".join([raw for _, _, raw in found])
                    decoded.append(joined.decode("utf-8", "replace").removeprefix(" "))
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column(0),
                        pa.array(counts, pa.int64()),
                        pa.array(ids_texts, pa.string()),
                        pa.array(decoded, pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids_text", "decoded"],
                )

    return run


def encode_documents(docs: DataFrame, proto: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_text (decimal ids joined by commas), decoded.

    Null or empty texts have no ids and decode to ''. Repeated rows come out each, null doc_ids stay null,
    an empty table gives no rows, further columns are ignored. Texts of any length: memory follows the longest
    text, not the partition. ``proto`` is the model file's content, so executors need no file.
    """
    rows = narrow(docs, doc_id=doc_id, text=text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(encode_partitions(proto), f"doc_id {kind}, n_tokens long, ids_text string, decoded string")


def ids_array(encoded: DataFrame) -> DataFrame:
    """Replace the joined ids by an array column ``ids``."""
    parts = F.when(F.col("ids_text") == "", F.array().cast("array<int>"))
    return encoded.withColumn("ids", parts.otherwise(F.split("ids_text", ",").cast("array<int>"))).drop("ids_text")
