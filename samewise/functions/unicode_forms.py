"""Compatibility folding shared by all text operators.

``fold_width`` brings width, kinds of space and invisible characters to one form;
``LATIN_LOOKALIKES`` lists Greek and Cyrillic letters drawn like Latin ones.
"""

from __future__ import annotations

import re
import unicodedata

# Letters of other scripts and the Latin letter of the same shape.
CYRILLIC_LIKE = "АВЕЅІЈКМНОРСТУХаеѕіјорсухԁһԛԝ"
CYRILLIC_AS_LATIN = "ABESIJKMHOPCTYXaesijopcyxdhqw"
GREEK_LIKE = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαινορυ"
GREEK_AS_LATIN = "ABEZHIKMNOPTYXaivopu"
LATIN_LOOKALIKES = dict(zip(CYRILLIC_LIKE, CYRILLIC_AS_LATIN, strict=True)) | dict(zip(GREEK_LIKE, GREEK_AS_LATIN, strict=True))

#: What has no width: format characters, variation selectors and fillers.
INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ\U000e0000-\U000e0fff]")
_LOOKALIKE_TABLE = str.maketrans(LATIN_LOOKALIKES)
#: The blocks of all letters that are look-alikes or fall apart into one; a text without any is not rebuilt.
_LOOKALIKE_BLOCKS = re.compile("[\u0370-\u052f\u1c80-\u1c8f\u1d00-\u1d7f\u1f00-\u1fff\u2de0-\u2dff\ua640-\ua69f]")


def fold_width(text: str | None) -> str:
    """NFKC without invisible characters, every run of white space one blank, trimmed; None gives ''."""
    if not text:
        return ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", INVISIBLE.sub("", text))
    return " ".join(text.split())


def plain_letters(text: str) -> bool:
    """Whether fold_letters leaves a text as it is whose spaces are folded and that has nothing invisible."""
    return text.isascii() or (unicodedata.is_normalized("NFKC", text) and not _LOOKALIKE_BLOCKS.search(text))


def fold_letters(text: str | None) -> str:
    """fold_width, then every look-alike letter as the Latin one: for parsing, where nothing is shown again."""
    folded = fold_width(text)
    return folded if folded.isascii() or not _LOOKALIKE_BLOCKS.search(folded) else unicodedata.normalize("NFC", unicodedata.normalize("NFD", folded).translate(_LOOKALIKE_TABLE))
