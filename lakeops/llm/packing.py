"""Best-fit packing of tokenised documents into sequences of a fixed length.

``pieces`` turns each document into pieces of at most ``capacity`` tokens.  ``pack`` deals the
pieces by hash into groups of bounded size, as many as the input needs, and packs each group
online: a piece goes into the open sequence with the least free space that still holds it.
Only ``open_bins`` sequences are open at a time; when one more is needed, the fullest closes.
The open ones are kept in one bitset with a bit for every free space that occurs, so the
tightest fit is the lowest set bit from the length of the piece upwards.

Documents without text (null or empty) are the end token alone.  Texts of any length are cut,
never dropped.  Repeated rows are packed as often as they occur; equal rows are interchangeable.
An empty table gives no rows.  Other columns of the input are ignored.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeops.llm.common import map_batches, utf8
from lakeops.session import settle

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
#: ASCII marks that the tokenizer never joins with letters before them; the apostrophe is not among them.
MARKS = b"!\"#$%&()*+,-./:;=?@[\\]^_`{|}~"


def stem(word: bytes) -> int:
    """Where the word's trailing marks begin; its end if the tokenizer could join them with what is before."""
    k = len(word.rstrip(MARKS))
    if not 0 < k < len(word) or b"'" in word:
        return len(word)
    # The tokenizer composes and lower-cases first, which can put a combining sign last.
    last = unicodedata.normalize("NFC", word[:k].decode()).lower()[-1]
    return k if unicodedata.category(last)[0] in "LN" else len(word)


class WordIds:
    """Token ids of texts, as little-endian 32-bit bytes, by way of a table of words.

    For a tokenizer that drops white space, ignores case and never joins characters over
    white space or from a letter or digit to a following mark, a text's ids are those of its words
    put together, and a word's those of its stem and its trailing marks, if the stem ends in a
    letter or digit; other words, and texts that may hold a special token, are given to the
    tokenizer whole.  The table is emptied at ``most`` words.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.most = Tokenizer.from_file(path), {}, most
        self.ends = {i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")}

    def encoded(self, parts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def encoded_letters(self, stems: list[str]) -> list[bytes]:
        """Stems of letters only, many to a text: the ids are parted after each word-end token."""
        out: list[bytes] = []
        for at in range(0, len(stems), 500):
            some, found, own = stems[at : at + 500], [], array("I")
            for i in self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids:
                own.append(i)
                if i in self.ends:
                    found.append(own.tobytes())
                    own = array("I")
            out += found if len(found) == len(some) and not own else self.encoded(some)
        return out

    def learn(self, words: set[bytes]) -> None:
        """Add words to the table; each new stem and each new run of marks is tokenised once."""
        known = self.known
        cut = {w: stem(w) for w in words}
        parts = {part for w, k in cut.items() for part in ((w[:k], w[k:]) if k < len(w) else (w,))}
        new = [(p, p.decode()) for p in parts if p not in known]
        model, other, letters = self.tokenizer.model, [], []
        for part, text in new:
            if not text.isalpha():
                other.append((part, text))
            elif text.isascii():  # neither folded nor split by the tokenizer's first steps
                known[part] = array("I", [t.id for t in model.tokenize(text)]).tobytes()
            else:
                letters.append((part, text))
        for some, encode in ((other, self.encoded), (letters, self.encoded_letters)):
            known.update(zip((p for p, _ in some), encode([t for _, t in some])))
        for w, k in cut.items():
            if w not in known:
                known[w] = known[w[:k]] + known[w[k:]]

    def ids(self, texts: list[bytes]) -> list[bytes]:
        if len(self.known) > self.most:
            self.known.clear()
        known, out = self.known, []
        for text in texts:
            if b"<|" in text:
                out.append(self.encoded([text.decode()])[0])
                continue
            words = text.lower().split()
            found = list(map(known.get, words))
            if None in found:
                self.learn({w for w, f in zip(words, found) if f is None})
                found = map(known.__getitem__, words)
            out.append(b"".join(found))
        return out


TABLES: dict[str, WordIds] = {}


def pieces(documents: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids): the documents' tokens in pieces.

    ``tokenizer`` is the path of a tokenizer file that every executor has.  ``ids`` (32-bit,
    little-endian) is null unless asked for.
    """

    def build():
        words = TABLES.get(tokenizer) or TABLES.setdefault(tokenizer, WordIds(tokenizer))
        end, most = np.array([end_id], "<u4").tobytes(), 4 * capacity

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for doc, ids in zip(batch["doc_id"].to_pylist(), words.ids(batch["text"].to_pylist())):
                ids += end
                for k, at in enumerate(range(0, len(ids), most)):
                    part = ids[at : at + most]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), part if keep_ids else None))
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=list(names))

        return run

    return map_batches(documents.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text")), build, PIECES)


def best_fit(lengths: list[int], capacity: int, open_bins: int) -> Iterator[tuple[int, int]]:
    """(bin, offset) of each length, in the order given."""
    spaces: list[list[int]] = [[] for _ in range(capacity + 1)]  # free space -> open bins
    bits, opened, bins = 0, 0, 0
    for length in lengths:
        fits = bits >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            at = spaces[space].pop()
            opened -= 1
            if not spaces[space]:
                bits ^= 1 << space
        else:
            space, at, bins = capacity, bins, bins + 1
        yield at, capacity - space
        space -= length
        if not space:
            continue
        if opened == open_bins:
            # One more would stay open: the fullest of them all closes, be it this one.
            least = (bits & -bits).bit_length() - 1
            if least >= space:
                continue
            spaces[least].pop()
            opened -= 1
            if not spaces[least]:
                bits ^= 1 << least
        spaces[space].append(at)
        bits |= 1 << space
        opened += 1


def pack(found: DataFrame, capacity: int = 4096, open_bins: int = 1024, group_rows: int = 8192) -> DataFrame:
    """Add (sequence_id, offset) to pieces.

    Pieces are dealt into ceil(rows / group_rows) groups by hash: a group fits in memory
    whatever the input's size, and no key decides where a piece goes.  Each group can leave
    some sequences partly filled; their share is that of one group, at any size.
    """
    groups = -(-found.count() // group_rows) or 1
    arrival = F.xxhash64("doc_id", "piece", "ids_crc32")
    dealt = found.withColumn("_at", arrival).withColumn("_group", F.pmod(F.xxhash64("_at"), F.lit(groups)))
    names = [f.name for f in found.schema.fields]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at", kind="stable")
        placed = np.array(list(best_fit(pdf["length"].tolist(), capacity, open_bins)), dtype=np.int64).reshape(-1, 2)
        pdf["sequence_id"] = pdf["_group"].to_numpy() * 2**32 + placed[:, 0]
        pdf["offset"] = placed[:, 1]
        return pdf[[*names, "sequence_id", "offset"]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields)
    return dealt.groupBy("_group").applyInPandas(one, f"{schema}, sequence_id long, `offset` long")


def pack_documents(documents: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """Documents to placed pieces; tokens are made once and written down before they are dealt."""
    found = pieces(documents, tokenizer, capacity, end_id, keep_ids)
    found = settle(found if keep_ids else found.drop("ids"), "pieces")
    return pack(found, capacity)
