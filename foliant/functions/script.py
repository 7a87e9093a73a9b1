"""Script detection and Uzbek Cyrillic to Latin transliteration."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.text import count_in, let

DETECTION_SAMPLE = 4000
GATHERED_SAMPLE = 8000
MIN_LETTERS = 10
CYRILLIC_SHARE = 0.3

CYRILLIC = r"\u0400-\u04ff"

# Letters of one language only, the letters after which e reads as ye, the
# letters that may follow a doubled i, and the letter table.
UZBEK_ONLY = "ўқғҳЎҚҒҲ"
RUSSIAN_ONLY = "ыщЫЩ"
YE_AFTER = "аеёиоуўэюяъьАЕЁИОУЎЭЮЯЪЬ"
UZBEK_LETTERS = "а-яёўқғҳА-ЯЁЎҚҒҲ"
LETTERS = {
    "а": "a", "б": "b", "в": "v", "г": "g", "ғ": "g‘", "д": "d", "е": "e", "ё": "yo",
    "ж": "j", "з": "z", "и": "i", "й": "y", "к": "k", "қ": "q", "л": "l", "м": "m",
    "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ў": "o‘",
    "ф": "f", "х": "x", "ҳ": "h", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sh", "ъ": "ʼ",
    "ы": "i", "ь": "", "э": "e", "ю": "yu", "я": "ya",
}

# A noncharacter, so it cannot clash with text: marks the letters of all-caps words.
CAPS_MARK = "\ufdd0"


def _class_without(first: int, last: int, letters: str) -> str:
    """Body of the class of what lies from ``first`` to ``last`` but for ``letters``, in few ranges."""
    cuts = [first - 1, *sorted(ord(letter) for letter in letters if first <= ord(letter) <= last), last + 1]
    return "".join(
        rf"\u{before + 1:04x}-\u{after - 1:04x}" for before, after in zip(cuts, cuts[1:]) if after - before > 1
    )


# After these e stays e: Cyrillic letters that are neither vowel nor sign, and the mark.
E_AFTER = _class_without(0x0400, 0x04FF, YE_AFTER) + CAPS_MARK


def count_letters(c: Column, letters: str) -> Column:
    # Literals are looked for in the bytes, which is much cheaper than a regex class or a translation.
    return let(c, lambda text: F.length(text) - F.length(_without(text, letters)))


def _without(c: Column, letters: str) -> Column:
    for letter in letters:
        c = F.replace(c, F.lit(letter), F.lit(""))
    return c


def _count_cyrillic(c: Column) -> Column:
    """Letters of the Cyrillic block: what is left of two bytes once all others beyond ASCII are gone."""
    plain = F.regexp_replace(c, rf"[\u0080-\x{{10ffff}}&&[^{CYRILLIC}]]+", "")
    return let(plain, lambda text: F.octet_length(text) - F.length(text))


def is_uzbek_cyrillic(c: Column, sample: int = DETECTION_SAMPLE) -> Column:
    def decide(head: Column) -> Column:
        return let(
            count_letters(head, UZBEK_ONLY),
            lambda uzbek: (uzbek > 0) & (uzbek >= count_letters(head, RUSSIAN_ONLY)),
        )

    return let(F.substring(c, 1, sample), decide)


def detect_script(c: Column, sample: int = DETECTION_SAMPLE) -> Column:
    """``uz-cyrl``, ``ru``, ``uz-latn`` or ``other``, from the first ``sample`` characters."""

    def cyrillic(head: Column) -> Column:
        return F.when(is_uzbek_cyrillic(head, sample), "uz-cyrl").otherwise("ru")

    def counted(head: Column, cyr: Column) -> Column:
        return let(
            count_in(head, "a-zA-Z"),
            lambda lat: F.when(cyr + lat < MIN_LETTERS, "other")
            .when(cyr / (cyr + lat) > CYRILLIC_SHARE, cyrillic(head))
            .when(lat > 0, "uz-latn")
            .otherwise("other"),
        )

    def decide(head: Column) -> Column:
        # Latin letters are counted only where the others leave it open.
        return let(
            _count_cyrillic(head),
            lambda cyr: F.when(
                (cyr >= MIN_LETTERS) & (cyr / F.length(head) > CYRILLIC_SHARE), cyrillic(head)
            )
            .when((cyr == 0) & head.rlike(rf"(?:[a-zA-Z][^a-zA-Z]*+){{{MIN_LETTERS}}}"), "uz-latn")
            .otherwise(counted(head, cyr)),
        )

    return let(F.substring(c, 1, sample), decide)


def script_sample(texts: Column, size: int = GATHERED_SAMPLE) -> Column:
    """Leading texts of an array, joined by a space until ``size`` is reached, cut there."""
    start = F.struct(F.lit(0).alias("chars"), F.lit(0).alias("n"))
    reached = F.aggregate(
        texts,
        start,
        lambda acc, text: F.when(acc.chars >= size, acc).otherwise(
            F.struct((acc.chars + F.length(text) + 1).alias("chars"), (acc.n + 1).alias("n"))
        ),
    )
    return F.substring(F.array_join(F.slice(texts, F.lit(1), reached.n), " "), 1, size)


def repair_final_ii(c: Column) -> Column:
    return let(
        c,
        lambda text: F.when(
            F.contains(text, F.lit("ии")), F.regexp_replace(text, f"ии(?![{UZBEK_LETTERS}])", "ий")
        ).otherwise(text),
    )


def expand_e(c: Column) -> Column:
    """Write e as ye at the start of a Cyrillic run and after a vowel or sign, else as e."""
    return F.translate(_expand_ye(c), "еЕ", "eE")


def _expand_ye(c: Column) -> Column:
    def at_ye(letter: str) -> str:
        # The letter leads the pattern, so the look-behind runs only where it occurs.
        return f"{letter}(?<![{E_AFTER}]{letter})"

    # Lower case first: an e it turned into Latin still opens the run for a following E, and
    # that E would be read as ye after an e in any case.
    lower = F.regexp_replace(c, at_ye("е"), "ye")
    return let(
        lower,
        lambda text: F.when(
            F.contains(text, F.lit("Е")), F.regexp_replace(text, at_ye("Е"), "Ye")
        ).otherwise(text),
    )


def _mark_caps(c: Column, letters: str) -> Column:
    """Put CAPS_MARK before every one of ``letters`` in a Cyrillic run that has no lower-case letter."""
    # The ranges leave out most lower-case letters.
    caps = r"[\u0400-\u042f\u0460-\u04ff&&[^\p{Ll}]]"
    first = rf"(?<![{CYRILLIC}])(?={caps}++(?![{CYRILLIC}]))"
    walk = rf"(?={caps})(?:{first}|(?<=[{CYRILLIC}])\G)((?:(?![{letters}]){caps})*+)([{letters}])"
    return F.regexp_replace(c, walk, "$1" + CAPS_MARK + "$2")


def _has_caps(c: Column, letters: str) -> Column:
    """False for most texts in which ``_mark_caps`` finds nothing, and only for such.

    One of ``letters`` without a small letter beside it. One range, which holds all but a few of the letters,
    leads the pattern, since every range and letter of a class costs a test at every character.
    """
    rare = "".join(letter for letter in letters if not "\u0400" <= letter <= "\u042f")
    small = r"[\u0430-\u04ff&&\p{Ll}]"
    found = c.rlike(rf"[\u0400-\u042f](?<=[{letters}])(?!{small})(?<!{small}.)")
    for letter in rare:
        found = F.contains(c, F.lit(letter)) | found
    return found


def to_latin(c: Column) -> Column:
    """Transliterate every Cyrillic run; other text is left as it is."""

    long_letters = {cyr: lat for cyr, lat in LETTERS.items() if len(lat) > 1}
    single = [(cyr, lat) for cyr, lat in LETTERS.items() if len(lat) == 1]
    dropped = [cyr for cyr, lat in LETTERS.items() if not lat]

    def all_caps(text: Column) -> Column:
        out = F.regexp_replace(
            text,
            f"{CAPS_MARK}Е(?<![{E_AFTER.replace(CAPS_MARK, '')}]{CAPS_MARK}Е)",
            "YE",
        )
        for cyr, lat in long_letters.items():
            out = F.replace(out, F.lit(CAPS_MARK + cyr.upper()), F.lit(lat.upper()))
        return out

    def convert(text: Column) -> Column:
        # All others are one letter in Latin too, so their case needs no mark.
        letters = "Е" + "".join(long_letters).upper()
        marked = let(
            repair_final_ii(text),
            lambda t: F.when(_has_caps(t, letters), _mark_caps(t, letters)).otherwise(t),
        )
        out = let(marked, lambda t: F.when(F.contains(t, F.lit(CAPS_MARK)), all_caps(t)).otherwise(t))
        # Single letters first: little Cyrillic is left for the others to be looked for in.
        out = F.translate(
            _expand_ye(out),
            "".join(cyr + cyr.upper() for cyr, _ in single)
            + "".join(cyr + cyr.upper() for cyr in dropped) + CAPS_MARK,
            "".join(lat + lat.upper() for _, lat in single),
        )
        for cyr, lat in long_letters.items():
            out = F.replace(out, F.lit(cyr.upper()), F.lit(lat.capitalize()))
            out = F.replace(out, F.lit(cyr), F.lit(lat))
        return out

    return let(c, lambda t: F.when(t.rlike(f"[{CYRILLIC}]"), convert(t)).otherwise(t))


def latin_if_uzbek(c: Column, script: Column) -> Column:
    """Only Uzbek Cyrillic documents are transliterated; Russian stays as it is."""
    return F.when(script == "uz-cyrl", to_latin(c)).otherwise(c)
