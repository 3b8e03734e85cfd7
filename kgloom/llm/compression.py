"""Text classes by zstandard dictionaries: the class whose dictionary codes a text in the fewest bytes."""

from __future__ import annotations

import regex
import zstandard

#: Runs of letters.
WORDS = regex.compile(r"\p{L}+")


def raw_dictionary(content: bytes, level: int) -> zstandard.ZstdCompressionDict:
    out = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    out.precompute_compress(level=level)
    return out


class Coder:
    """Lengths of texts coded with one dictionary, without frame extras."""

    def __init__(self, content: bytes, level: int):
        self.coder = zstandard.ZstdCompressor(level=level, dict_data=raw_dictionary(content, level), write_content_size=False,
            write_checksum=False, write_dict_id=False)

    def lengths(self, windows: list[bytes]) -> list[int]:
        code = self.coder.compress
        return [len(code(w)) for w in windows]


def byte_windows(text: bytes, size: int) -> list[bytes]:
    return [text[i : i + size] for i in range(0, len(text), size)] or [b""]
