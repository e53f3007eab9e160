"""Language of a text by its most common small words and letters (TXT12, TXT13)."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Small words that tell languages apart, and ranges of letters that decide alone.
WORDS = {
    "en": "the and of to in that is was for with this from are by".split(),
    "de": "der die und den von zu das mit des auf ist im dem nicht ein eine".split(),
    "fr": "le la les et des en du que une est pour dans qui par sur au avec".split(),
    "es": "el los las y que en del se por con para una es al su lo como".split(),
    "it": "il di che e la per un non sono con del della gli".split(),
    "pt": "o os as e que em do da para com um uma nao por dos".split(),
    "nl": "de het een en van dat te op voor met zijn niet".split(),
}
SCRIPTS = {"ja": "぀-ヿ", "ko": "가-힣", "zh": "一-鿿", "ru": "Ѐ-ӿ", "ar": "؀-ۿ", "el": "Ͱ-Ͽ", "he": "֐-׿", "th": "฀-๿", "hi": "ऀ-ॿ"}
_WORD = re.compile(r"[^\W\d_]+")


def detect(text: str | None) -> str | None:
    """ISO 639-1 code, or None for a text that says too little."""
    if not text or not text.strip():
        return None
    letters = len(re.findall(r"[^\W\d_]", text))
    for code, span in SCRIPTS.items():
        if letters and len(re.findall(f"[{span}]", text)) > 0.2 * letters:
            return code
    seen = Counter(w.lower() for w in _WORD.findall(text))
    marks = {code: sum(seen[w] for w in words) for code, words in WORDS.items()}
    best = max(marks, key=marks.get)
    return best if marks[best] >= max(1, 0.02 * sum(seen.values())) else None


def language(text) -> Column:
    def run(x: pd.Series) -> pd.Series:
        return x.map(detect)

    return F.pandas_udf(run, "string")(text)


def needs_translation(label: str, content: str, target: str) -> bool:
    text = f"{label} {content}".strip()
    return bool(text) and detect(text) != target
