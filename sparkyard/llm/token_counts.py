"""Token counts: batches of whole texts through a SentencePiece model, lengths only.

Long texts are split at safe boundaries. A boundary is safe at a single space between two
non-space characters when no piece of the vocabulary holds a space after another character:
no merge can then cross it, and the dummy prefix of the second part stands for the space.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame

from .common import fields, map_texts

#: Characters above which a text is split.
SPLIT_CHARS = 1 << 16
_SAFE = re.compile("(?<=[^ ▁]) (?=[^ ▁])")


@lru_cache(maxsize=4)
def load(path: str):
    """The model, and whether its texts can be split at spaces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    crossing = any(re.search("[^▁]▁", p) for p in pieces)
    # the dummy prefix, and spaces kept as they are
    plain = model.encode("a  b", out_type=str) == model.encode("a", out_type=str) + model.encode(" b", out_type=str)
    return model, plain and not crossing


def split_safe(text: str, limit: int = SPLIT_CHARS) -> list[str]:
    """Parts of at most about limit characters whose token counts add up to the text's."""
    parts, start = [], 0
    while len(text) - start > limit:
        cut = _SAFE.search(text, start + limit)
        if cut is None:
            break
        parts.append(text[start : cut.start()])
        start = cut.end()
    return [*parts, text[start:]]


def count_batch(texts: list[str], path: str, split_chars: int = SPLIT_CHARS) -> list[int]:
    model, splits = load(path)
    parts, owner = [], []
    for i, t in enumerate(texts):
        for p in split_safe(t, split_chars) if splits and len(t) > split_chars else [t]:
            parts.append(p)
            owner.append(i)
    counts = [0] * len(texts)
    for i, ids in zip(owner, model.encode(parts, num_threads=1), strict=True):
        counts[i] += len(ids)
    return counts


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keep, n_bytes (UTF-8), n_tokens, over_limit for every row of docs.

    Null and empty texts count 0 bytes and 0 tokens; a null id stays; repeated rows each give a
    row; an empty table gives none; other columns of docs, clashing names among them, are not
    read. Very long texts are split at safe boundaries and counted whole, in one task each. The
    model adds no begin or end tokens; strings of special tokens in a text are ordinary text.
    """

    def work(texts: list[str]) -> dict[str, list]:
        n = count_batch(texts, model_path)
        return {"n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

    return map_texts(docs, list(keep), fields("n_bytes bigint, n_tokens bigint, over_limit boolean"), work, text)
