"""English plurals and their singulars, as rules on suffixes with the words that they don't hold for."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Plurals that no rule covers, alone or at the end of a compound.
IRREGULAR = {
    "men": "man", "women": "woman", "children": "child", "people": "person", "feet": "foot", "teeth": "tooth", "geese": "goose", "mice": "mouse", "lice": "louse", "dice": "die", "oxen": "ox", "pence": "penny", "brethren": "brother",
    "quizzes": "quiz", "whizzes": "whiz", "movies": "movie", "cookies": "cookie", "zombies": "zombie", "rookies": "rookie", "calories": "calorie", "prairies": "prairie", "eyries": "eyrie", "genies": "genie", "smoothies": "smoothie", "hoodies": "hoodie", "selfies": "selfie", "collies": "collie", "birdies": "birdie",
    "shoes": "shoe", "toes": "toe", "canoes": "canoe", "oboes": "oboe", "hoes": "hoe", "foes": "foe", "woes": "woe", "throes": "throe", "does": "doe",
    "criteria": "criterion", "phenomena": "phenomenon", "automata": "automaton", "polyhedra": "polyhedron", "bacteria": "bacterium", "media": "medium", "data": "datum", "memoranda": "memorandum", "curricula": "curriculum", "strata": "stratum", "errata": "erratum", "addenda": "addendum", "symposia": "symposium", "ova": "ovum", "spectra": "spectrum", "stadia": "stadium", "aquaria": "aquarium",
    "genera": "genus", "corpora": "corpus", "opera": "opera", "alumni": "alumnus", "fungi": "fungus", "nuclei": "nucleus", "cacti": "cactus", "stimuli": "stimulus", "radii": "radius", "foci": "focus", "syllabi": "syllabus", "loci": "locus", "bacilli": "bacillus", "termini": "terminus", "hippopotami": "hippopotamus", "octopi": "octopus",
    "formulae": "formula", "larvae": "larva", "algae": "alga", "vertebrae": "vertebra", "antennae": "antenna", "nebulae": "nebula", "alumnae": "alumna", "cherubim": "cherub", "seraphim": "seraph",
    "crises": "crisis", "oases": "oasis", "lenses": "lens", "irises": "iris", "pelvises": "pelvis", "trellises": "trellis",
}

#: Words that look like plurals and aren't.
SAME = (
    "series", "species", "news", "means", "headquarters", "crossroads", "mathematics", "physics", "economics", "politics", "athletics", "linguistics", "statistics", "ethics", "gymnastics", "electronics", "genetics", "mechanics", "dynamics", "semantics", "corps", "chassis", "gallows", "always", "perhaps", "besides", "towards", "whereas", "yes", "gas", "bias", "alias", "atlas", "canvas", "pancreas", "christmas", "lens", "his", "this", "was", "has", "thus",
    "texas", "kansas", "arkansas", "dallas", "athens", "wales", "paris", "james", "charles", "thomas", "nicholas", "lucas", "jones", "hercules",
)

_WITH_F = "wol|el|shel|sel|cal|hal|loa|lea|thie|shea|scar|dwar|whar|hoo|turf"
#: Fixed values: (what a word ends in, what is cut off, what takes its place); the first that fits holds.
RULES = (
    (r"(ss|us|is|'s|[^e]es'|s')$", r"$", ""),
    (rf"(^|[a-z])({_WITH_F})ves$", r"ves$", "f"),
    (r"(^|[^o])(kni|wi)ves$|^(after|half|night)?lives$", r"ves$", "fe"),
    (r"(anal|paral|catal|dial|electrol|hydrol)yses$", r"es$", "is"),
    (r"(diagn|progn|neur|psych|hypn|metamorph|symbi|osm|thromb|fibr|scler|tubercul|cirrh)oses$", r"es$", "is"),
    (r"(^|hypo|syn|anti|paren|pros|photosyn)theses$|(gen|nem)eses$", r"es$", "is"),
    (r"(ind|vert|vort|cod|ap|lat)ices$", r"ices$", "ex"),
    (r"(matr|append|hel|cicatr)ices$", r"ices$", "ix"),
    (r"(bur|plat|tabl|chat|troupe?)eaux$", r"x$", ""),
    (r"[^aeiou]ies$", r"ies$", "y"),
    (r"(^|[^a-z])(head|tooth|heart|stomach|back|ear)?aches$|(^ca|ni|avalan|coman|cre|qui|mousta|musta|apa|psy|pors|pasti|porti)ches$", r"s$", ""),
    (r"(ches|shes|xes|sses|zzes|[^aeiou]oes)$", r"es$", ""),
    (r"(^|[ao]|^f|^m|^r|^am|^ab|^exc|^acc|^ref|^conf|^inf|^bem|^def|^eff|^dif|^prof|^transf|^re|^mis|^over|^per)uses$", r"s$", ""),
    (r"uses$", r"es$", ""),
    (r"(^gas|atlas|canvas|alias|bias|pancreas|christmas)es$", r"es$", ""),
    (r"..s$", r"s$", ""),
)

#: What compounds of irregular words end in, and words that end so by chance.
_COMPOUND = (
    (r"[a-z]men$", r"(speci|regi|abdo|^o|acu|se|hy|sta|bitu|^a|ra|lu|albu|cycla|exa|tegu|ye|car|bre|fora|cera|culmi|wo)men$", r"men$", "man"),
    (r"[a-z]women$", r"$^", r"women$", "woman"),
    (r"[a-z]children$", r"$^", r"children$", "child"),
    (r"(dor|title?)mice$", r"$^", r"mice$", "mouse"),
    (r"(eye|milk|buck|saw)teeth$", r"$^", r"teeth$", "tooth"),
    (r"(fore|bare|club|flat|pale|tender|web|crow)feet$", r"$^", r"feet$", "foot"),
)


def singular(t: Column) -> Column:
    """The singular of one token, its capitals kept at the beginning; null for none of the plurals known."""
    low = F.lower(t)
    known = F.element_at(F.from_json(F.lit(json.dumps(IRREGULAR)), "map<string,string>"), low)
    cased = F.when(F.substring(t, 1, 1) == F.upper(F.substring(t, 1, 1)), F.concat(F.upper(F.substring(known, 1, 1)), F.substring(known, 2, 99))).otherwise(known)
    out = F.when(low.isin(*SAME), t).when(known.isNotNull(), cased)
    for ends, chance, tail, to in _COMPOUND:
        out = out.when(low.rlike(ends) & ~low.rlike(chance), F.regexp_replace(t, f"(?i){tail}", to))
    for ends, tail, to in RULES:
        out = out.when(low.rlike(ends) & ((F.length(t) > 4) | F.lit(ends != r"[^aeiou]ies$")), F.regexp_replace(t, f"(?i){tail}", to))
    return out
