"""Token ids of whole texts, as little-endian unsigned 32-bit bytes.

Byte-level BPE with the pattern of the given vocabulary never joins what stands before a white-space
run with the run itself: a piece that starts with no white space ends before the next one. So the ids
of a text are the ids of its parts "white space, then non-space" one after another, and a part that
came before need not be encoded again. Likewise a line feed before a word and a stop or comma after a
letter or digit are pieces of their own. The vocabulary's added token holds no white space, so a text is cut
around it in the part it stands in as it is in the whole. The parts are encoded by the tokenizers library.
"""

from __future__ import annotations

import os
import re
import struct

from duskboard.llm.frames import kept_in_worker

#: The id that ends a document.
END = b"\0\0\0\0"
#: Parts a worker remembers; about 200 bytes each.
REMEMBERED = 1_200_000
PART = re.compile(r"\s*\S+|\s+")


class Encoder:
    """Encodes texts by the parts they consist of. ``limit`` bounds the parts it remembers."""

    LONGEST = 48

    def __init__(self, path: str, limit: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit = limit
        self.own = dict(zip("\n.,", self._encode(list("\n.,")), strict=True))
        self.known: dict[str, bytes] = {}

    def _encode(self, parts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in (e.ids for e in encoded)]

    def _learn(self, parts: set[str]) -> dict[str, bytes]:
        """The ids of parts that are not known; short ones are remembered."""
        if len(self.known) > self.limit:
            self.known.clear()
        known, cores = self.known, {}
        for part in parts:
            start = part[0] == "\n" and not part[1:2].isspace()
            end = part[-1] in ".," and part[-2:-1].isalnum()
            cores[part] = (start, part[start : len(part) - end], end)
        new = list({core for _, core, _ in cores.values() if core not in known})
        ids = dict(zip(new, self._encode(new), strict=True))
        for part, (start, core, end) in cores.items():
            got = ids[core] if core in ids else known[core]
            ids[part] = (self.own["\n"] if start else b"") + got + (self.own[part[-1]] if end else b"")
        known.update((k, v) for k, v in ids.items() if len(k) <= self.LONGEST)
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        parts, ends = [], []
        for text in texts:
            parts += PART.findall(text)
            ends.append(len(parts))
        ids = list(map(self.known.get, parts))
        new = [i for i, got in enumerate(ids) if got is None]
        if new:
            learned = self._learn({parts[i] for i in new})
            for i in new:
                ids[i] = learned[parts[i]]
        return [b"".join(ids[a:b]) for a, b in zip([0, *ends], ends, strict=False)]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def worker_encoder(path: str, limit: int = REMEMBERED) -> Encoder:
    """The encoder of this worker process; it is loaded once and keeps the parts it knows between tasks."""
    return kept_in_worker(("encoder", path, limit), lambda: Encoder(path, limit))
