"""The words of a text, as every operator here that works on words takes them."""

from __future__ import annotations

import re

#: The ranges of CJK characters.
CJK = "぀-ヿ㐀-鿿"
_WORD = re.compile(f"[{CJK}]|(?:(?![{CJK}])[^\\W_])+")


def words(text: str | None) -> list[str]:
    """After lower-casing, each CJK character and each maximal run of other letters and digits; null and blank texts have none."""
    return _WORD.findall(text.lower()) if text else []
