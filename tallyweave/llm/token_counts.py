"""Token counts: batch encoding in Arrow functions that return lengths only.

Batches are balanced by bytes, and long texts are split at boundaries where the
tokenizer can never join what stands on both sides, so counts stay exact.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

#: Texts of more bytes are split, in pieces of about CHUNK characters, and CALL bytes are encoded in one call.
CHUNK = 1 << 16
CALL = 1 << 20

_loaded: dict[str, "Counter"] = {}


class Counter:
    """Counts the tokens of texts with one tokenizer file (.json or .model).

    ``cut`` finds a space that may be split at: both neighbours are no spaces, so
    it starts a word. ``drop`` says whether the space itself goes (the tokenizer
    ignores it, or puts it before every text by itself).
    """

    def __init__(self, path: str):
        self.cut, self.drop = None, True
        if path.endswith(".model"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
            # no piece crosses the start of a word, and two spaces stay two
            if not any("▁" in p.lstrip("▁") for p in pieces) and sp.encode("a  b") == sp.encode("a") + sp.encode("  b")[1 if sp.encode("  b", out_type=str)[0] == "▁" else 0:]:
                self.cut = re.compile("(?<=[^\\s▁]) (?=[^\\s▁])")
            self.lengths = lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            with open(path) as f:
                steps = str(json.load(f).get("pre_tokenizer"))
            if "'behavior': 'Removed', 'invert': True" in steps and "[^\\\\s" in steps:  # white space is dropped
                self.cut = re.compile("(?<=\\S) (?=\\S)")
            elif "ByteLevel" in steps and "'use_regex': True" in steps and "'add_prefix_space': False" in steps:
                self.cut, self.drop = re.compile("(?<=\\S) (?=\\S)"), False  # a space goes with the word after it
            self.lengths = lambda texts: [len(x.ids) for x in t.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, text: str) -> list[str]:
        if len(text) <= CHUNK or self.cut is None:
            return [text]
        out, start = [], 0
        while (m := self.cut.search(text, start + CHUNK)):
            out.append(text[start:m.start()])
            start = m.end() if self.drop else m.start()
        return [*out, text[start:]]

    def counts(self, texts: list[str | None], sizes: list[int]) -> list[int]:
        """Tokens of each text, given its bytes; null counts as empty. Calls have about equal bytes."""
        out, call, held = [0] * len(texts), [], 0
        for i, (text, size) in enumerate(zip(texts, sizes, strict=True)):
            for p in (self.pieces(text) if size > CHUNK else [text]) if text else ():
                call.append((i, p))
                held += len(p.encode()) if size > CHUNK else size
                if held >= CALL:
                    self._add(out, call)
                    call, held = [], 0
        self._add(out, call)
        return out

    def _add(self, out: list[int], call: list[tuple[int, str]]) -> None:
        if call:
            for (i, _), n in zip(call, self.lengths([p for _, p in call]), strict=True):
                out[i] += n


def counter(path: str) -> Counter:
    if path not in _loaded:
        _loaded[path] = Counter(path)
    return _loaded[path]


def token_counts(docs: DataFrame, path: str, text: str = "text", limit: int = 4096) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    One narrow stage, no shuffle. A null text counts as empty (0 bytes, 0 tokens).
    Columns of these names that ``docs`` already has are replaced; all other
    columns and all rows, repeated ones too, stay as they are.
    """

    @F.arrow_udf(T.LongType())
    def lengths(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = counter(path)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch), 0).to_pylist()
            yield pa.array(c.counts(batch.to_pylist(), sizes), pa.int64())

    n = F.coalesce(lengths(F.col(text)), F.lit(0).cast("long"))
    return docs.withColumn("n_tokens", n).withColumns({
        "n_bytes": F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long"),
        "over_limit": F.col("n_tokens") > limit,
    })
