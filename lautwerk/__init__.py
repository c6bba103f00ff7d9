"""Fault-tolerant resolution of personal names on Spark."""

from .functions.distance import similarity
from .functions.text import cologne, core_of, normalize, prefix_of, skeleton, spell_out, strip_accents
from .operators.browse import list_names, search, stats
from .operators.decide import hydrate, hydrate_plain, suggest
from .operators.lexicon import Lexicon, build, merge
from .operators.match import candidates, lookup, match, probability, variants_of
from .service import Names, Options

__all__ = [
    "Lexicon", "Names", "Options", "build", "candidates", "cologne", "core_of", "hydrate", "hydrate_plain", "list_names",
    "lookup", "match", "merge", "normalize", "prefix_of", "probability", "search", "similarity", "skeleton", "spell_out",
    "stats", "strip_accents", "suggest", "variants_of",
]
