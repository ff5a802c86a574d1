"""Sizes of texts in tokens of a public tokenizer; its file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..runtime import python_map

#: Byte-level BPE of about 50,000 tokens, as ranks.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the byte-level BPE cuts words before it merges.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
_loaded: dict[str, object] = {}
_sent: dict[tuple[str, str], object] = {}


def _encoding(ranks: bytes):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks=table, special_tokens={})


def tokenizer(path: str = TOKENIZER):
    """The tokenizer of a rank file."""
    if path not in _loaded:
        with open(path, "rb") as f:
            _loaded[path] = _encoding(f.read())
    return _loaded[path]


def _sizes(path: str, ranks, keep: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if path not in _loaded:  # built once a process
            _loaded[path] = _encoding(ranks.value)
        encode = _loaded[path].encode_ordinary
        for pdf in batches:
            out = pdf[keep].copy()
            out["tokens"] = [len(encode(t)) for t in pdf["text"]]
            yield out

    return run


def token_sizes(documents: DataFrame, *keep: str, path: str = TOKENIZER) -> DataFrame:
    """``keep`` columns and ``tokens`` of each text; null and empty texts are left out.

    The driver reads the rank file and sends its bytes to the executors, once
    an application; the file has one size whatever the data.
    """
    sc = documents.sparkSession.sparkContext
    key = (sc.applicationId, path)
    if key not in _sent:
        with open(path, "rb") as f:
            _sent[key] = sc.broadcast(f.read())
    source = documents.select(*keep, "text").where("text <> ''")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*keep).schema.fields)
    return python_map(source, _sizes(path, _sent[key], list(keep)), schema + ", tokens bigint")
