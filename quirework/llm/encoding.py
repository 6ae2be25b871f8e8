"""Token ids of texts, as the `tokenizers` library gives them for a vocabulary file.

Where a file is plain byte-level BPE of one of the two kinds below, its merges
run in tiktoken's engine, several times as fast. tiktoken joins any two
neighbours whose bytes are in the vocabulary, `tokenizers` only the listed
pair. The two agree if every entry of the vocabulary, encoded alone, gives
itself: all merges of lower rank inside an entry's bytes happen in any text as
they do in the entry alone, so no other pair ever meets there. That is tested
when the file is loaded; a file that fails, and each text with characters
beyond Latin script or with the string of an added token, goes through
`tokenizers` with its own defaults.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Letters and digits among the characters of the fast path.
_LETTER, _DIGIT = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"
#: The fast path takes texts of ordinary ASCII, Latin-1 and Latin Extended-A letters (but the dotted capital I).
_SLOW = re.compile(r"[^\t\n\r -~\xa1-\xac\xae-įı-ſ]")
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^\s{_LETTER}{_DIGIT}]+|\n")
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Ends each word in the engine; texts that hold it are not on the fast path.
_END = "\x01"

_encoders: dict[tuple[str, str], "Encoder"] = {}


def _byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _kind_of(spec: dict) -> str | None:
    """"bytes" or "words" for the two kinds of file that the fast path knows."""
    model, before, normal = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if model.get("type") != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges") or model.get("continuing_subword_prefix"):
        return None
    if before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and normal is None and not model.get("end_of_word_suffix"):
        return "bytes"
    steps = before.get("pretokenizers", [])
    if model.get("end_of_word_suffix") == "</w>" and [x["type"] for x in steps] == ["Split", "ByteLevel"] and steps[0]["pattern"] == {"Regex": _WORD_SPLIT} and steps[0]["invert"] and not steps[1]["use_regex"] and [x["type"] for x in (normal or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
        return "words"
    return None


def _consistent(merges: list[tuple[str, str]], suffix: str) -> bool:
    """Does every merged entry, encoded alone, give itself?"""
    rank = {pair: i for i, pair in enumerate(merges)}
    for a, b in merges:
        whole = a + b
        stem = whole.removesuffix(suffix) if suffix else whole
        parts = list(stem)
        if len(stem) < len(whole):
            parts[-1] += suffix
        while len(parts) > 1:
            best = min(((rank.get(p, 1 << 30), i) for i, p in enumerate(zip(parts, parts[1:], strict=False))), default=(1 << 30, 0))
            if best[0] == 1 << 30:
                return False
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return True


class Encoder:
    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype(kind)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=0) > np.iinfo(self.kind).max:
            raise ValueError(f"ids of {path} don't fit {self.kind.itemsize} bytes")
        self.added = sorted({y for x in spec.get("added_tokens") or [] for y in (x["content"][:2], x["content"][:2].lower(), x["content"][:2].upper())})
        self.mode = _kind_of(spec)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"].get("merges", [])]
        suffix = "</w>" if self.mode == "words" else ""
        if self.mode and _consistent(merges, suffix):
            self._engine(spec["model"]["vocab"], merges, suffix)
        else:
            self.mode = None

    def _engine(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str) -> None:
        import tiktoken

        symbol = _byte_symbols()

        def raw(token: str) -> bytes:
            stem = token.removesuffix(suffix) if suffix else token
            return bytes(symbol[c] for c in stem) + (_END.encode() if len(stem) < len(token) else b"")

        ranks, ids = {}, []
        single = [bytes([b]) for b in range(256)]
        names = {b: c for c, b in symbol.items()}
        for b in single:
            ranks[b] = len(ids)
            ids.append(vocab.get(names[b[0]], 0))
        if suffix:  # a byte and the end of its word come together first of all
            for b in single:
                ranks[b + _END.encode()] = len(ids)
                ids.append(vocab.get(names[b[0]] + suffix, 0))
        for a, b in merges:
            ranks[raw(a + b)] = len(ids)
            ids.append(vocab[a + b])
        self.to_id = np.array(ids).astype(self.kind)
        self.line = ranks.get(b"\n" + _END.encode())
        self.engine = tiktoken.Encoding("own", pat_str=f"[^{_END}]+{_END}" if suffix else _BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})

    def _slow(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind).tobytes()

    def _of_runs(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all runs (without white space), one after the other, and the number of each: one call of the engine, where a line break parts runs."""
        lines = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(runs)], pa.int32()), runs.cast(pa.string())), "\n")[0].as_py() + "\n"
        ranks = self.engine.encode_to_numpy(_END.join(_WORDS.findall(lines)) + _END, disallowed_special=())
        breaks = ranks == self.line
        return self.to_id[ranks[~breaks]], np.diff(np.flatnonzero(breaks), prepend=-1) - 1

    def _by_words(self, texts: list[str]) -> list[bytes]:
        """What stands between white space is encoded once for all texts, as no word spans it."""
        lower = pa.array([(x if x.isascii() else unicodedata.normalize("NFC", x)).lower() for x in texts], pa.large_string())
        runs = pc.ascii_split_whitespace(lower)
        coded = runs.flatten().dictionary_encode()
        values, lengths = self._of_runs(coded.dictionary)
        first = np.cumsum(lengths) - lengths
        place = np.asarray(coded.indices)
        each = lengths[place]
        ends = np.cumsum(each)
        data = values[np.repeat(first[place] - ends + each, each) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        edges = (np.concatenate(([0], ends))[np.asarray(runs.offsets)] * self.kind.itemsize).tolist()
        return [data[a:b] for a, b in zip(edges, edges[1:], strict=False)]

    def _holds_added(self, text: str) -> bool:
        """Has the text the first two characters of an added token, in any case? Only such texts can hold one."""
        return any(a in text for a in self.added)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text."""
        slow = [self.mode is None or bool(_SLOW.search(x)) or self._holds_added(x) for x in texts]
        fast = [x for x, s in zip(texts, slow, strict=True) if not s]
        if self.mode == "words":
            done = iter(self._by_words(fast) if fast else [])
        else:
            done = (self.to_id[self.engine.encode_to_numpy(x, disallowed_special=())].tobytes() if x else b"" for x in fast)
        return [self._slow(x) if s else next(done) for x, s in zip(texts, slow, strict=True)]


def encoder(path: str, kind: str = "<u2") -> Encoder:
    """One of each in a Python worker."""
    if (path, kind) not in _encoders:
        _encoders[path, kind] = Encoder(path, kind)
    return _encoders[path, kind]
