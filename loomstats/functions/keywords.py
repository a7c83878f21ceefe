"""Tokenisation of free text for keyword counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE

# Words that are no keywords.
ENGLISH_STOP_WORDS = (
    "a an the and or but not nor so yet for as at by in of on to up it its is are was were be been being have has had do "
    "does did will would could should may might shall can how what when where who whom which why this that these those i "
    "me my we our you your he him his she her they them their if then than also just too very more all no from with about "
    "into please here there out off over same other each both such only some any"
).split()
JAPANESE_STOP_WORDS = (
    "実装 お願い コード エラー ついて 変更 追加 修正 確認 について します してください してほしい ください ます です した して する しても "
    "が を は に で と の も や から より まで など ため これ それ あれ この その あの どの こと もの ある いる ない なる れる られる せる させる "
    "たい ほしい みる おく いく くる くれる もらう"
).split()
# Fixed pattern: characters between words (whitespace, ASCII and CJK punctuation).
SEPARATORS = (
    "[" + SPACE + r"\x{ff0c}\x{3001}\x{3002}\x{ff01}\x{ff1f}!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_{|}~"
    r"\x{300c}\x{300d}\x{300e}\x{300f}\x{3010}\x{3011}]+"
)
URL = f"https?://[^{SPACE}]*"


def raw_words(text: Column) -> Column:
    """Pieces of a text between separators, URLs left out."""
    without_urls = F.when(text.contains("://"), F.regexp_replace(text, URL, " ")).otherwise(text)
    return F.split(without_urls, SEPARATORS)


def keyword(word: Column) -> Column:
    """The keyword a piece stands for: lower case; null for numbers, stop words and single characters."""
    bare = F.btrim(word, F.lit("`"))
    lower = F.lower(bare)
    kept = (
        (F.length(bare) >= 2) & ~lower.isin(*ENGLISH_STOP_WORDS) & ~bare.isin(*JAPANESE_STOP_WORDS)
        & ~bare.rlike(r"\A[0-9]+\z")
    )
    return F.when(kept, lower)
