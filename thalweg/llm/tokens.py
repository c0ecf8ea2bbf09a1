"""Public tokenizers, loaded once per Python worker from a path that is a parameter."""

from __future__ import annotations

import base64
from functools import lru_cache

#: Where the ranks file lies by default; every operator takes another path.
RANKS_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the public byte-level vocabulary cuts text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoder(path: str = RANKS_PATH):
    """A byte-pair encoder over the ranks file; special tokens are ordinary text to it."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
