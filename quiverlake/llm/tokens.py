"""Public tokenizers inside kernels."""

from __future__ import annotations

import base64
import json

#: The vocabulary's name for the library that ships the files.
BYTE_BPE = "byte_bpe_50k"


def encoder(name: str = BYTE_BPE, path: str | None = None, pattern: str | None = None):
    """text -> ids that the JSON file of the byte-level vocabulary ``name`` gives without added special tokens.

    A special string in the text, as <|endoftext|>, is its one id.  The
    merge-rank file gives the same ids for a text without such strings and is
    some five times faster; a text that holds one, or whose runs the fast matcher
    can't take, goes to the JSON tokenizer.  ``path``: the rank file, with the
    JSON file beside it, else those of the installed package.
    """
    import public_tokenizers
    import tiktoken

    at = path or public_tokenizers.path(f"{name}.tiktoken")
    contract = (path or public_tokenizers.path(f"{name}.json")).replace(".tiktoken", ".json")
    with open(at, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(contract, encoding="utf-8") as f:
        added = [t["content"] for t in json.load(f)["added_tokens"]]
    fast = tiktoken.Encoding(name, pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow: list = []

    def encode(text: str) -> list[int]:
        if not any(t in text for t in added):
            try:
                return fast.encode_ordinary(text)
            except BaseException as e:  # the library's panics are no Exceptions
                if not isinstance(e, ValueError) and type(e).__name__ != "PanicException":
                    raise
        if not slow:
            from tokenizers import Tokenizer

            slow.append(Tokenizer.from_file(contract))
        return slow[0].encode(text, add_special_tokens=False).ids

    return encode
