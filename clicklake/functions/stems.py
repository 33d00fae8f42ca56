"""Stems of Danish words, after the published description of the Snowball algorithm for Danish."""

from __future__ import annotations

from functools import cache

#: Fixed values of the algorithm: vowels, letters before which a final s may be an ending, and endings.
VOWELS = "aeiouyæåø"
S_AFTER = "abcdfghjklmnoprtvyzå"
ENDINGS = """hed ethed ered e erede ende erende ene erne ere en heden eren er heder erer heds es endes erendes enes ernes eres ens hedens erens ers ets erets et eret s""".split()
PAIRS = ("gd", "dt", "gt", "kt")
OTHER = ("elig", "lig", "els", "ig", "løst")


def _region(word: str) -> int:
    """Where the first region begins: behind the first consonant after a vowel, three letters in at least."""
    i, n = 0, len(word)
    while i < n and word[i] not in VOWELS:
        i += 1
    while i < n and word[i] in VOWELS:
        i += 1
    return max(3, i + 1) if i < n else n


def _ending(word: str, region: int, endings) -> str:
    """The longest of the endings that lies in the region."""
    return max((e for e in endings if word.endswith(e) and len(word) - len(e) >= region), key=len, default="")


def _pair(word: str, region: int) -> str:
    return word[:-1] if _ending(word, region, PAIRS) else word


@cache
def danish(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) < 4:
        return word
    region = _region(word)
    end = _ending(word, region, ENDINGS)
    if end == "s":
        word = word[:-1] if word[-2] in S_AFTER else word
    else:
        word = word[: len(word) - len(end)]
    word = _pair(word, region)
    if word.endswith("igst"):
        word = word[:-2]
    end = _ending(word, region, OTHER)
    if end == "løst":
        word = word[:-1]
    elif end:
        word = _pair(word[: -len(end)], region)
    if len(word) - 1 >= region and len(word) > 1 and word[-1] == word[-2] and word[-1].isalpha() and word[-1] not in VOWELS:
        word = word[:-1]
    return word


def danish_sql(term: str) -> str:
    """The same in DuckDB, as one expression over a column of lower-case words: each step a regular expression on the region."""
    region = f"(SELECT *, CASE WHEN regexp_matches(t0, '^[^{VOWELS}]*[{VOWELS}]+[^{VOWELS}]') THEN greatest(3, length(regexp_extract(t0, '^[^{VOWELS}]*[{VOWELS}]+[^{VOWELS}]'))) ELSE length(t0) END AS p FROM (SELECT {term} AS t0))"
    tail = lambda t, words: f"regexp_extract(substr({t}, p + 1), '({'|'.join(words)})$')"
    one = f"(SELECT *, {tail('t0', ENDINGS)} AS e0 FROM {region})"
    cut_ = f"(SELECT *, CASE WHEN e0 = 's' THEN CASE WHEN contains('{S_AFTER}', substr(t0, length(t0) - 1, 1)) THEN substr(t0, 1, length(t0) - 1) ELSE t0 END ELSE substr(t0, 1, length(t0) - length(e0)) END AS t1 FROM {one})"
    pair = lambda t: f"CASE WHEN {tail(t, PAIRS)} <> '' THEN substr({t}, 1, length({t}) - 1) ELSE {t} END"
    two = f"(SELECT *, {pair('t1')} AS t2 FROM {cut_})"
    three = f"(SELECT *, CASE WHEN ends_with(t2, 'igst') THEN substr(t2, 1, length(t2) - 2) ELSE t2 END AS t3 FROM {two})"
    ends = f"(SELECT *, {tail('t3', OTHER)} AS e3 FROM {three})"
    four = f"(SELECT *, CASE WHEN e3 = 'løst' THEN substr(t3, 1, length(t3) - 1) ELSE substr(t3, 1, length(t3) - length(e3)) END AS t4 FROM {ends})"
    again = f"(SELECT *, CASE WHEN e3 NOT IN ('', 'løst') THEN {pair('t4')} ELSE t4 END AS t5 FROM {four})"
    double = f"CASE WHEN length(t5) - 1 >= p AND substr(t5, length(t5), 1) = substr(t5, length(t5) - 1, 1) AND regexp_matches(t5, '[^\\P{{L}}{VOWELS}]$') THEN substr(t5, 1, length(t5) - 1) ELSE t5 END"
    return f"CASE WHEN length({term}) < 4 THEN {term} ELSE (SELECT {double} FROM {again}) END"
