"""SentencePiece encoding and decoding: Viterbi over an Aho-Corasick automaton of the pieces.

The automaton reads a text once; at each place its output links give every piece that ends there, longest first, and each
relaxes the best score of the place (strictly better wins, so the longest of equals stays). Letters that no piece covers
cost UNKNOWN below the worst piece and become byte pieces. Piece scores are those of the model file; the result is the
segmentation of the highest total score (the unigram rule), also for a model file that was trained by merges. Since no
piece goes on across the start of a word (checked when the model is loaded), words are solved apart and remembered.

Defined cases: null counts as empty and has no pieces; white space other than spaces is kept as it is; a text with the
space mark U+2581 decodes to a space there, every other text decodes to itself; repeated rows encode alike; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import per_text, text_or_empty

SPACE = "▁"
UNKNOWN = 10.0
CACHE = 300_000
_WORD = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_known: dict[str, Codec] = {}


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Codec:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        self.automaton, self.data, self.byte = ahocorasick.Automaton(), [], {}
        worst, self.splits = 0.0, True
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.data.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i):
                self.data.append(b"")
            else:
                self.automaton.add_word(piece, (len(piece), sp.get_score(i), i))
                self.data.append(piece.encode())
                worst = min(worst, sp.get_score(i))
                self.splits &= SPACE not in piece.lstrip(SPACE)
        self.automaton.make_automaton()
        self.unknown_score, self.unknown = worst - UNKNOWN, sp.unk_id()
        self.words: dict[str, bytes] = {}

    def best(self, text: str) -> list[int]:
        """Ids of the best segmentation: one pass over the automaton's matches."""
        n = len(text)
        score, came = [0.0] + [-np.inf] * n, [(0, -1)] * (n + 1)
        done = 0

        def unknown(upto: int) -> None:
            nonlocal done
            while done < upto:  # all pieces that end at a place are in before it is passed
                if score[done] + self.unknown_score > score[done + 1]:
                    score[done + 1], came[done + 1] = score[done] + self.unknown_score, (done, -1)
                done += 1

        for end, (length, value, i) in self.automaton.iter(text):
            unknown(end)  # places before this end are final
            start = end + 1 - length
            if score[start] + value > score[end + 1]:
                score[end + 1], came[end + 1] = score[start] + value, (start, i)
        unknown(n)
        out: list[int] = []
        at = n
        while at:
            start, i = came[at]
            if i < 0:
                raw = text[start:at].encode("utf-8", "surrogatepass")
                out += [self.byte.get(b, self.unknown) for b in reversed(raw)]
            else:
                out.append(i)
            at = start
        return out[::-1]

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        marked = SPACE + text.replace(" ", SPACE)
        words = _WORD.findall(marked) if self.splits else [marked]
        if len(self.words) > CACHE:
            self.words.clear()
        known, out = self.words, []
        for w in words:
            ids = known.get(w)
            if ids is None:
                ids = np.array(self.best(w), "<u4").tobytes()
                if len(w) <= 48:
                    known[w] = ids
            out.append(ids)
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.data.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:]


def codec(path: str) -> Codec:
    if path not in _known:
        _known[path] = Codec(path)
    return _known[path]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """A row per document: doc_id, n_pieces, n_bytes (byte pieces), ids (binary, little-endian 32 bits), ids_crc32, decoded."""
    rows, model = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")), path or model_path()

    def run(texts: list[str]) -> tuple:
        c = codec(model)
        is_byte = np.zeros(len(c.data), bool)
        is_byte[list(c.byte.values())] = True
        ids = [c.encode(t) for t in texts]
        raw = [x.tobytes() for x in ids]
        return [len(x) for x in ids], [int(is_byte[x].sum()) for x in ids], raw, [zlib.crc32(x) for x in raw], [c.decode(x) for x in ids]

    return per_text(rows, {"n_pieces": "long", "n_bytes": "long", "ids": "binary", "ids_crc32": "long", "decoded": "string"}, run)


def decode(rows: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """``rows`` with the text of their ids as ``decoded``; null ids decode to the empty text."""
    model = path or model_path()
    text = F.pandas_udf(lambda ids: ids.map(lambda x: codec(model).decode(np.frombuffer(x or b"", "<u4"))), "string")
    return rows.withColumn("decoded", text(ids_col))
