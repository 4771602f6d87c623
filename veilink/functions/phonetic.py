"""Double Metaphone codes (after L. Philips, 2000), as a table of context rules.

A word is read from left to right. For each letter the rules of that letter are tried in order; the first whose context
holds gives the primary and secondary sounds and how many letters it eats.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOWELS = "AEIOUY"
SLAVO_GERMANIC = re.compile(r"W|K|CZ|WITZ")

# For each letter its rules as (what precedes, what follows from the letter on, primary, secondary, letters eaten).
# ``^`` is the start of the word, ``$`` its end; ``1`` in the eaten column is the letter alone. {S} marks a rule for Slavo-Germanic
# words only, {N} one for others.
RULES: dict[str, tuple[tuple[str, str, str, str, int], ...]] = {
    "B": ((r"", r"BB", "P", "P", 2), (r"", r"B", "P", "P", 1)),
    "C": (
        (r"(?:^|[^AEIOUY])A$", r"CH(?![IE])", "K", "K", 2), (r"^.?[^AEIOUY]A$", r"CH(?!I)", "K", "K", 2), (r"^$", r"CAESAR", "S", "S", 2), (r"^$", r"CHIA", "K", "K", 2),
        (r".", r"CHAE", "K", "X", 2), (r"^$", r"CH(?:ARAC|ARIS|OR(?!E)|YM|IA|EM)", "K", "K", 2), (r"^(?:VAN |VON |SCH).*$", r"CH", "K", "K", 2), (r"(?:OR|AR)$", r"CH(?:ES|IT|ID)", "K", "K", 2),
        (r"", r"CH[TS]", "K", "K", 2), (r"(?:^|[AOUE])$", r"CH(?:[LRNMBHFVW ]|$)", "K", "K", 2), (r"^MC$", r"CH", "K", "K", 2), (r"^M$", r"CH", "K", "K", 2), (r"^$", r"CH", "X", "X", 2), (r"", r"CH", "X", "K", 2),
        (r"(?<!WI)$", r"CZ", "S", "X", 2), (r"", r"CIA", "X", "X", 3), (r"^.?UC$", r"C(?:E(?=E)|ES)", "KS", "KS", 2), (r"^A$", r"CC(?=[IEH])(?!HU)", "KS", "KS", 3),
        (r"U$", r"CC(?:EE|ES)", "KS", "KS", 3), (r"(?!^M$)", r"CC(?=[IEH])(?!HU)", "X", "X", 3), (r"(?!^M$)", r"CC", "K", "K", 2), (r"", r"C[KGQ]", "K", "K", 2), (r"", r"CI[OEA]", "S", "X", 2),
        (r"", r"C[IEY]", "S", "S", 2), (r"", r"C [CQG]", "K", "K", 3), (r"", r"C[CKQ](?!E|I)", "K", "K", 2), (r"", r"C", "K", "K", 1),
    ),
    "D": ((r"", r"DG[IEY]", "J", "J", 3), (r"", r"DG", "TK", "TK", 2), (r"", r"D[TD]", "T", "T", 2), (r"", r"D", "T", "T", 1)),
    "F": ((r"", r"FF", "F", "F", 2), (r"", r"F", "F", "F", 1)),
    "G": (
        (r"[^AEIOUY]$", r"GH", "K", "K", 2), (r"^$", r"GHI", "J", "J", 2), (r"^$", r"GH", "K", "K", 2), (r"[BHD].$", r"GH", "", "", 2), (r"[BHD]..$", r"GH", "", "", 2), (r"[BH]...$", r"GH", "", "", 2),
        (r"[CGLRT].U$", r"GH", "F", "F", 2), (r"I$", r"GH", "", "", 2), (r".", r"GH", "K", "K", 2), (r"^[AEIOUY]$", r"GN{N}", "KN", "N", 2), (r"", r"GN(?!EY){N}", "N", "KN", 2), (r"", r"GN", "KN", "KN", 2),
        (r"", r"GLI{N}", "KL", "L", 2), (r"^$", r"G(?:Y|ES|EP|EB|EL|EY|IB|IL|IN|IE|EI|ER)", "K", "J", 2), (r"(?<!^DAN)(?<!^RAN)(?<!^MAN)(?<![EIRO])$", r"G(?:ER|Y)(?<!RGY)(?<!OGY)", "K", "J", 2),
        (r"^(?:VAN |VON |SCH).*$", r"G[EIY]", "K", "K", 2), (r"", r"GET", "K", "K", 2), (r"(?:A|O)G$|(?:A|O)$", r"GGI", "J", "K", 2), (r"", r"GIER(?:$| )", "J", "J", 2), (r"", r"G[EIY]", "J", "K", 2), (r"", r"GG", "K", "K", 2), (r"", r"G", "K", "K", 1),
    ),
    "H": ((r"(?:^|[AEIOUY])$", r"H[AEIOUY]", "H", "H", 2), (r"", r"H", "", "", 1)),
    "J": (
        (r"^$", r"JOSE(?:$| )", "H", "H", 1), (r"^SAN $", r"J", "H", "H", 1), (r"", r"JOSE", "J", "H", 1), (r"^$", r"JJ?", "J", "A", 1), (r"[AEIOUY]$", r"J[AO]{N}", "J", "H", 1),
        (r"", r"J$", "J", "", 1), (r"[SKL]$", r"J", "", "", 1), (r"", r"J[LTKSNMBZ]", "", "", 1), (r"", r"JJ", "J", "J", 2), (r"", r"J", "J", "J", 1),
    ),
    "K": ((r"", r"KK", "K", "K", 2), (r"", r"K", "K", "K", 1)),
    "L": ((r"I$", r"LL(?:O|A)S?$", "L", "", 2), (r"A$", r"LLE(?:$|(?=.*(?:[AO]|[AO]S)$))", "L", "", 2), (r"", r"LL", "L", "L", 2), (r"", r"L", "L", "L", 1)),
    "M": ((r"U$", r"MB(?:$|ER)", "M", "M", 2), (r"", r"MM", "M", "M", 2), (r"", r"M", "M", "M", 1)),
    "N": ((r"", r"NN", "N", "N", 2), (r"", r"N", "N", "N", 1)),
    "P": ((r"", r"PH", "F", "F", 2), (r"", r"P[PB]", "P", "P", 2), (r"", r"P", "P", "P", 1)),
    "Q": ((r"", r"QQ", "K", "K", 2), (r"", r"Q", "K", "K", 1)),
    "R": ((r"(?<!ME)(?<!MA)IE$", r"R${N}", "", "R", 1), (r"", r"RR", "R", "R", 2), (r"", r"R", "R", "R", 1)),
    "S": (
        (r"[IY]$", r"SL", "", "", 1), (r"^$", r"SUGAR", "X", "S", 1), (r"", r"SH(?:EIM|OEK|OLM|OLZ)", "S", "S", 2), (r"", r"SH", "X", "X", 2), (r"", r"SI[OA]{N}", "S", "X", 3), (r"", r"SI[OA]", "S", "S", 3),
        (r"^$", r"S[MNLW]", "S", "X", 1), (r"", r"SZ", "S", "X", 2), (r"", r"SCH(?:ER|EN)", "X", "SK", 3), (r"", r"SCH(?:OO|UY|ED|EM)", "SK", "SK", 3), (r"^$", r"SCH(?=[^AEIOUYW])", "X", "S", 3), (r"", r"SCH", "X", "X", 3),
        (r"", r"SC[IEY]", "S", "S", 3), (r"", r"SC", "SK", "SK", 3), (r"[AO]I$", r"S$", "", "S", 1), (r"", r"SS", "S", "S", 2), (r"", r"S", "S", "S", 1),
    ),
    "T": (
        (r"", r"TION", "X", "X", 3), (r"", r"TIA|TCH", "X", "X", 3), (r"^(?:VAN |VON |SCH).*$", r"TH", "T", "T", 2), (r"", r"TH(?:OM|AM)", "T", "T", 2), (r"", r"TTH", "0", "T", 3), (r"", r"TH", "0", "T", 2), (r"", r"T[TD]", "T", "T", 2), (r"", r"T", "T", "T", 1),
    ),
    "V": ((r"", r"VV", "F", "F", 2), (r"", r"V", "F", "F", 1)),
    "W": (
        (r"", r"WR", "R", "R", 2), (r"^$", r"W[AEIOUY]", "A", "F", 1), (r"^$", r"WH", "A", "A", 1), (r"[AEIOUY]$", r"W$", "", "F", 1), (r"", r"W(?<=E)SK[IY]", "", "F", 1), (r"[EO]$", r"WSK[IY]", "", "F", 1), (r"^SCH.*$", r"W", "", "F", 1),
        (r"", r"WI(?:CZ|TZ)", "TS", "FX", 4), (r"", r"W", "", "", 1),
    ),
    "X": ((r"^$", r"X", "S", "S", 1), (r"(?:IAU|EAU|AU|OU)$", r"X$", "", "", 1), (r"", r"X[CX]", "KS", "KS", 2), (r"", r"X", "KS", "KS", 1)),
    "Z": ((r"", r"ZH", "J", "J", 2), (r"", r"ZZ(?=O|I|A)", "S", "TS", 2), (r"", r"Z(?=O|I|A)", "S", "TS", 1), (r"[^T]$", r"Z{S}", "S", "TS", 1), (r"", r"ZZ", "S", "S", 2), (r"", r"Z", "S", "S", 1)),
}
SILENT_STARTS = re.compile(r"^(?:GN|KN|PN|WR|PS)")


@lru_cache(maxsize=1)
def _compiled():
    made: dict[str, list] = {}
    for letter, rules in RULES.items():
        made[letter] = []
        for before, ahead, first, second, eaten in rules:
            kind = "S" if "{S}" in ahead else "N" if "{N}" in ahead else ""
            ahead = ahead.replace("{S}", "").replace("{N}", "")
            if before and not before.startswith("(?!") and not before.endswith("$"):
                before += "$" if not before.startswith("^") else ".*$"
            made[letter].append((re.compile(before), re.compile(ahead), first, second, eaten, kind))
    return made


@lru_cache(maxsize=65536)
def double_metaphone(word: str) -> tuple[str, str]:
    """Primary and secondary code of a word; the secondary is empty where it equals the primary."""
    text = word.upper().replace("Ç", "S").replace("Ñ", "N")
    text = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    slavic = bool(SLAVO_GERMANIC.search(text))
    first, second, i = "", "", 1 if SILENT_STARTS.match(text) else 0
    if text.startswith("X"):
        first, second, i = "S", "S", 1
    while i < len(text):
        letter = text[i]
        if letter in VOWELS:
            if i == 0:
                first, second = first + "A", second + "A"
            i += 1
            continue
        for before, ahead, a, b, eaten, kind in _compiled().get(letter, ()):
            if kind == "S" and not slavic or kind == "N" and slavic:
                continue
            if before.search(text[:i]) and ahead.match(text, i):
                first, second, i = first + a, second + b, i + eaten
                break
        else:
            i += 1
    return first, "" if second == first else second


def double_metaphone_codes(c: Column) -> Column:
    """Codes of the words between white space, in order, each word's primary and then its secondary; empty codes are left out."""

    @F.pandas_udf("array<string>")
    def codes(values: pd.Series) -> pd.Series:
        return values.map(lambda v: [code for w in (v or "").split() for code in double_metaphone(w) if code])

    return codes(c)
