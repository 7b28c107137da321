"""Public tokenizers by name. The folder of their files is a parameter; nothing of them is copied here."""

from __future__ import annotations

import base64
import os
from functools import cache

#: Where the vocabulary files lie; overridden by an argument or FIELDLOOM_TOKENIZERS.
FOLDER = "/opt/tokenizers"

# Fixed value: the public pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def folder(at: str | None = None) -> str:
    return at or os.environ.get("FIELDLOOM_TOKENIZERS", FOLDER)


@cache
def bpe(name: str, at: str):
    """The byte-level BPE of a rank file; strings that look like special tokens are ordinary text."""
    import tiktoken

    with open(os.path.join(at, f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@cache
def encoder(name: str, at: str | None = None):
    """A function from a list of texts to their lists of ids. Null and empty texts have no ids."""
    at = folder(at)
    if os.path.exists(os.path.join(at, f"{name}.tiktoken")):
        encode = bpe(name, at).encode_ordinary
        return lambda texts: [encode(clean(t)) if t else [] for t in texts]
    if os.path.exists(os.path.join(at, f"{name}.model")):
        import sentencepiece

        piece = sentencepiece.SentencePieceProcessor(model_file=os.path.join(at, f"{name}.model"))
        return lambda texts: piece.encode([clean(t) if t else "" for t in texts], num_threads=1)
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    fast = Tokenizer.from_file(os.path.join(at, f"{name}.json"))
    fast.encode_special_tokens = True
    return lambda texts: [e.ids for e in fast.encode_batch([clean(t) if t else "" for t in texts], add_special_tokens=False)]


def clean(text: str) -> str:
    """Lone surrogates, which no tokenizer takes, as U+FFFD."""
    try:
        text.encode()
        return text
    except UnicodeEncodeError:
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
