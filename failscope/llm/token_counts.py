"""Token counts: batch encoding inside Arrow functions that return lengths only.

*Pieces.* Texts are split at boundaries that no token crosses, so that the counts of the pieces add
up to the text's: at ASCII white space for tokenizers that drop it, before a space that follows a
visible character for byte-level ones, at single spaces for sentence pieces. The pieces of a share
of a batch are dictionary-encoded: each different piece is encoded once, and the lengths are taken
back to the texts by vectorised sums.

*Batches.* The tokenizer gets the different pieces in batches of about ``BATCH_BYTES`` bytes of
UTF-8. A text of more than ``SHARE_BYTES`` is split into shares, and a piece of more than
``BATCH_BYTES``, as in texts without spaces, is cut between two characters that stand beside each
other in no token of the vocabulary (:class:`PieceCutter`). Only what has no such place is encoded
whole, however long it is.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from failscope.llm.common import table
from failscope.llm.shingles import text_slices

#: Bytes of the pieces that one call of the tokenizer gets.
BATCH_BYTES = 256 << 10
#: Bytes of text that are split into pieces at a time.
SHARE_BYTES = 32 << 20
TOKEN_LIMIT = 2048

_LOADED: dict[str, Encoder] = {}


@dataclass
class Encoder:
    """``lengths``: from strings to numbers of tokens. ``pieces``: from texts to the pieces of each.
    ``cut``: a long piece as (string, tokens too many) whose lengths add up to its own. ``skip``:
    characters left out where a text is split at a single space between visible characters, None if
    it can't be split there."""

    lengths: Callable[[list[str]], list[int]]
    pieces: Callable[[pa.Array], pa.ListArray]
    cut: Callable[[str, int], list[tuple[str, int]]]
    skip: int | None


def load(path: str) -> Encoder:
    """The encoder of a tokenizer file; loaded once a process."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _LOADED[path] = _sentence_pieces(path) if path.endswith(".model") else _tokenizer(path)
    return _LOADED[path]


def _whole(piece: str, most: int) -> list[tuple[str, int]]:
    return [(piece, 0)]


def _listed(split: Callable[[str], list[str]]) -> Callable[[pa.Array], pa.ListArray]:
    return lambda texts: pa.array([split(t) for t in texts.to_pylist()], pa.list_(pa.large_string()))


def _sentence_pieces(path: str) -> Encoder:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    crossing = any("\u2581" in model.id_to_piece(i).lstrip("\u2581") for i in range(model.get_piece_size()))
    # each piece gets the mark of a space in front, so a single space can be left out between two
    split = (lambda t: [t]) if crossing else re.compile(r"(?<=\S) (?=\S)").split
    return Encoder(lambda pieces: [len(x) for x in model.encode(pieces, num_threads=1)], _listed(split), _whole, None if crossing else 1)


def _tokenizer(path: str) -> Encoder:
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    with open(path) as f:
        config = json.load(f)
    lengths = lambda pieces: [len(x) for x in model.encode_batch_fast(pieces, add_special_tokens=False)]
    specials = [t["content"] for t in config.get("added_tokens", [])]
    spaced = any(any(c.isspace() for c in t["content"]) or t["lstrip"] or t["rstrip"] for t in config.get("added_tokens", []))
    if drops_white_space(config):
        cutter = PieceCutter(model, specials, lengths)
        return Encoder(lengths, lambda texts: pc.ascii_split_whitespace(texts), cutter.cut, 1)
    first = config.get("pre_tokenizer") or {}
    bytewise = first.get("type") == "ByteLevel" and first.get("use_regex") and not first.get("add_prefix_space") and not config.get("normalizer") and not spaced
    return Encoder(lengths, _listed(re.compile(r"(?<=\S)(?= )").split if bytewise else lambda t: [t]), _whole, 0 if bytewise else None)


def drops_white_space(config: dict) -> bool:
    r"""Whether the tokenizer cuts at white space and drops it: its first pre-tokenizer removes all
    but matches of a pattern whose only classes are ``\p{L}``, ``\p{N}`` and ``[^\s\p{L}\p{N}]``."""
    steps = (config.get("pre_tokenizer") or {}).get("pretokenizers") or [config.get("pre_tokenizer") or {}]
    first = steps[0]
    if first.get("type") != "Split" or first.get("behavior") != "Removed" or not first.get("invert"):
        return False
    pattern = first["pattern"].get("Regex", "")
    specials = any(any(c.isspace() for c in t["content"]) or t["lstrip"] or t["rstrip"] for t in config.get("added_tokens", []))
    return not specials and r"[^\s\p{L}\p{N}]+" in pattern and r"\s" not in pattern.replace(r"[^\s\p{L}\p{N}]+", "") and " " not in pattern


class PieceCutter:
    """Cuts pieces of a tokenizer that splits words, maps their bytes to letters and merges pairs.

    A merge makes a token of the vocabulary, so no merge joins two letters that stand beside each
    other in no token: the tokens of both sides are the same with and without the other. The end of
    a word has letters of its own, so the left side is encoded with the first character of the right
    side, whose own tokens are then too many.
    """

    def __init__(self, model, specials: list[str], lengths: Callable[[list[str]], list[int]]):
        from tokenizers import pre_tokenizers

        self.normal = model.normalizer.normalize_str if model.normalizer else lambda x: x
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = lambda x: "".join(p for p, _ in level.pre_tokenize_str(x))
        suffix = getattr(model.model, "end_of_word_suffix", None) or ""
        tokens = (t.removesuffix(suffix) if suffix else t for t in model.get_vocab(with_added_tokens=False))
        self.beside = {pair for t in tokens for pair in zip(t, t[1:], strict=False)}
        self.specials, self.lengths = specials, lengths
        self.apart = lru_cache(1 << 20)(self._apart)

    def _apart(self, a: str, b: str) -> bool:
        """Whether no token and no rule of normalisation joins the characters a and b."""
        if a == "'" or unicodedata.combining(b) or unicodedata.normalize("NFC", a + b) != a + b or a.isspace() or b.isspace():
            return False
        left, right = self.letters(self.normal(a)), self.letters(self.normal(b))
        return bool(left and right) and (left[-1], right[0]) not in self.beside

    def safe(self, piece: str, i: int) -> bool:
        if not self.apart(piece[i - 1], piece[i]):
            return False
        return not any(s in piece[max(0, i - len(s) + 1) : i + len(s) - 1] for s in self.specials)

    def cut(self, piece: str, most: int) -> list[tuple[str, int]]:
        """Parts of about ``most`` bytes, each with the tokens that it has too many."""
        out, begin, step = [], 0, max(1, most // 4)  # a character has four bytes at most
        while begin + step < len(piece):
            end = begin + step
            at = next((i for i in range(end, begin, -1) if self.safe(piece, i)), None) or next((i for i in range(end + 1, len(piece)) if self.safe(piece, i)), None)
            if at is None:
                break
            out.append((piece[begin : at + 1], self.lengths([piece[at]])[0]))
            begin = at
        return [*out, (piece[begin:], 0)]


def balanced(pieces: list[str], sizes, batch_bytes: int = BATCH_BYTES):
    """Runs of ``pieces``, whose UTF-8 has ``sizes`` bytes, of about ``batch_bytes`` bytes; a longer
    piece is a run of its own."""
    run, held = [], 0
    for piece, size in zip(pieces, sizes, strict=True):
        if run and held + size > batch_bytes:
            yield run
            run, held = [], 0
        run.append(piece)
        held += size
    if run:
        yield run


def piece_lengths(pieces: pa.Array, encoder: Encoder, batch_bytes: int = BATCH_BYTES) -> np.ndarray:
    """Numbers of tokens of different pieces."""
    texts, sizes = pieces.to_pylist(), pc.binary_length(pieces).to_pylist()
    out = np.zeros(len(texts), dtype=np.int64)
    strings, owners, lengths = [], [], []
    for i, (text, size) in enumerate(zip(texts, sizes, strict=True)):
        for part, extra in [(text, 0)] if size <= batch_bytes else encoder.cut(text, batch_bytes):
            strings.append(part)
            owners.append(i)
            lengths.append(size if part is text else len(part.encode()))
            out[i] -= extra
    counts = [n for run in balanced(strings, lengths, batch_bytes) for n in encoder.lengths(run)]
    np.add.at(out, owners, counts)
    return out


_VISIBLE = re.compile(r"(?<=\S) (?=\S)")


def _shares(text: str, encoder: Encoder, most: int):
    """A very long text as shares of about ``most`` characters that end at a single space."""
    begin = 0
    while encoder.skip is not None and len(text) - begin > most and (space := _VISIBLE.search(text, begin + most)):
        yield text[begin : space.start()]
        begin = space.start() + encoder.skip
    yield text[begin:]


def text_lengths(texts: pa.Array, encoder: Encoder, batch_bytes: int = BATCH_BYTES, share_bytes: int = SHARE_BYTES) -> np.ndarray:
    """Numbers of tokens of texts, none of them null."""
    texts = texts.cast(pa.large_string())
    out = np.zeros(len(texts), dtype=np.int64)
    for begin, end in text_slices(texts, share_bytes):
        part = texts.slice(begin, end - begin)
        groups = [part]
        if end == begin + 1 and pc.binary_length(part)[0].as_py() > share_bytes:
            groups = (pa.array([x], pa.large_string()) for x in _shares(part[0].as_py(), encoder, share_bytes))
        for group in groups:
            split = encoder.pieces(group)
            coded = split.flatten().dictionary_encode()
            lengths = piece_lengths(coded.dictionary, encoder, batch_bytes)
            upto = np.concatenate([[0], np.cumsum(lengths[coded.indices.to_numpy(zero_copy_only=False)])])
            offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
            out[begin:end] += upto[offsets[1:]] - upto[offsets[:-1]]
    return out


def count_batches(batches, path: str, batch_bytes: int = BATCH_BYTES, share_bytes: int = SHARE_BYTES):
    """Arrow batches with ``text`` as last column -> the other columns, n_bytes and n_tokens."""
    encoder = load(path)
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pc.binary_length(texts).cast(pa.int64()), pa.array(text_lengths(texts, encoder, batch_bytes, share_bytes))],
            names=[*batch.schema.names[:-1], "n_bytes", "n_tokens"],
        )


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = TOKEN_LIMIT) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_tokens, over_limit.

    Null texts count as empty and have no token. Null doc_ids and repeated rows stay as they are. No
    rows give no rows. Columns other than doc_id and text are ignored.
    """
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    schema = f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long"
    counted = plain.mapInArrow(lambda it: count_batches(it, tokenizer_path), schema)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    """All documents: doc_id, n_bytes, n_tokens, over_limit."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
