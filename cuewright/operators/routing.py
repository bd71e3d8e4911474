"""Which recognition profile reads a language: overrides, then languages, then scripts, then the default."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, lookup, recogniser_language, script_subtag, spellings, strip

#: Profile names and their other spellings.
PROFILES = {"english": ["english", "eng"], "latin": ["latin", "latn"], "multilingual": ["multilingual", "multi"], "japanese": ["japanese", "jpn", "ja"], "korean": ["korean", "kor", "ko"], "cjk": ["cjk", "zho", "zh", "chinese"]}

#: The shipped routing table.
LANGUAGE_PROFILES = spellings({"english": ["eng", "en"], "japanese": ["jpn", "ja"], "korean": ["kor", "ko"], "cjk": ["zho", "zh", "chi", "chi_sim", "chi_tra"]})
SCRIPT_PROFILES = spellings({
    "latin": ["latn"],
    "japanese": ["jpan", "hira", "kana"],
    "korean": ["hang", "kore"],
    "cjk": ["hani", "hans", "hant", "bopo"],
    "multilingual": ["cyrl", "arab", "hebr", "grek", "deva", "thai", "beng", "taml", "telu", "knda", "mlym", "sinh", "laoo", "khmr", "mymr", "ethi", "tibt"],
})
LIKELY_SCRIPTS = spellings({
    "latn": ["eng", "en", "fra", "fre", "fr", "spa", "es", "deu", "ger", "de", "ita", "it", "por", "pt", "nld", "dut", "nl", "swe", "sv", "nor", "no", "dan", "da", "fin", "fi", "ron", "rum", "ro", "pol", "pl", "ces", "cze", "cs", "hun", "hu", "tur", "tr", "cat", "ca", "glg", "gl", "ind", "id", "vie", "vi"],
    "cyrl": ["rus", "ru", "ukr", "uk", "bel", "bul", "srp", "mkd", "kaz", "kir", "tgk", "mon"],
    "arab": ["ara", "ar", "fas", "per", "fa", "urd", "ur", "pus", "ps"],
})


class Routing(NamedTuple):
    """Small dimensions: they become map literals in the plan."""

    languages: dict[str, str] = LANGUAGE_PROFILES
    scripts: dict[str, str] = SCRIPT_PROFILES
    likely: dict[str, str] = LIKELY_SCRIPTS
    default: str = "latin"

    @classmethod
    def of(cls, raw: dict) -> Routing:
        """From a parsed manifest; keys lower-cased and trimmed."""
        clean = lambda d: {k.strip().lower(): v.strip().lower() for k, v in d.items()}
        return cls(clean(raw.get("language_profiles", {})), clean(raw.get("script_profiles", {})), clean(raw.get("likely_scripts", {})), raw.get("default_profile", "latin").strip().lower())


def profile(language: Column, routing: Routing = Routing(), overrides: dict[str, str] | None = None, script_hints: dict[str, str] | None = None) -> Column:
    """The profile of a language tag. A script without a profile reads as english, no script as the default."""
    names = spellings(PROFILES)
    lower = ascii_lower(strip(language))
    code = F.coalesce(recogniser_language(language), lower)
    keys = [lower, code, F.split(lower, "[-_]")[0], F.split(code, "[-_]")[0]]

    def first_of(table: dict[str, str]) -> list[Column]:
        return [lookup(key, table) for key in keys] if table else []

    known = lambda table: {k: names[v] for k, v in table.items() if v in names}
    script = F.coalesce(script_subtag(strip(language)), *(ascii_lower(c) for c in first_of({k.lower(): v for k, v in (script_hints or {}).items()})), *first_of(routing.likely), F.lit(None).cast("string"))
    by_script = F.when(script.isNotNull(), lookup(script, known(routing.scripts), F.lit("english")) if routing.scripts else F.lit("english"))
    given = first_of(known({k.lower(): v for k, v in (overrides or {}).items()}))
    return F.coalesce(*given, *first_of(known(routing.languages)), by_script, F.lit(routing.default))
