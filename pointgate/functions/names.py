"""Name normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented letters of the data and their plain letters.
ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöøùúûüýÿ"
PLAIN = "AAAAAACEEEEIIIINOOOOOOUUUUYaaaaaaceeeeiiiinoooooouuuuyy"


#: First names that stand for each other, the first of a line for all of it.
FIRST_NAMES = [
    ["mike", "michael"], ["chris", "christopher", "kris"], ["matt", "matthew"],
    ["rob", "robert", "bob", "bobby"], ["will", "william", "bill", "billy"],
    ["dan", "daniel", "danny"], ["dave", "david"], ["jim", "james", "jimmy"],
    ["joe", "joseph", "joey"], ["josh", "joshua"], ["ben", "benjamin"],
    ["alex", "alexander"], ["zach", "zachary", "zack"], ["jon", "jonathan"],
    ["steve", "steven", "stephen"], ["tony", "anthony"], ["drew", "andrew", "andy"],
    ["nick", "nicholas"], ["pat", "patrick"], ["greg", "gregory"],
    ["ken", "kenneth", "kenny"], ["jeff", "jeffrey"], ["tom", "thomas", "tommy"],
    ["gabe", "gabriel"], ["cam", "cameron"], ["mitch", "mitchell"],
    ["ron", "ronald", "ronnie"], ["ray", "raymond"], ["sam", "samuel"],
    ["ted", "theodore"], ["dj", "d j"], ["aj", "a j"], ["cj", "c j"],
]
#: Whole names that stand for another.
ALIASES = {"beaniewells": "chriswells"}
_FIRST = {v: line[0] for line in FIRST_NAMES for v in line}


def norm_name(name: Column) -> Column:
    """Plain lower-case letters and digits without punctuation, blanks or a suffix such as 'jr' or 'iii'; first names by their short form."""
    x = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.translate(name, ACCENTED, PLAIN)), r"[^a-z0-9 ]", ""), r" +", " "))
    x = F.regexp_replace(x, r"(^| )((jr|sr|ii|iii|iv|v)( |$))+$", "")
    first = F.substring_index(x, " ", 1)
    short = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in _FIRST.items() for v in kv]), first), first)
    key = F.concat(short, F.replace(F.substring(x, F.length(first) + 1, F.length(x)), F.lit(" "), F.lit("")))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in ALIASES.items() for v in kv]), key), key)


_PLAIN_SQL = "regexp_replace(trim(regexp_replace(regexp_replace(lower(translate({0}, '" + ACCENTED + "', '" + PLAIN + "')), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g'), ' '), '(^| )((jr|sr|ii|iii|iv|v)( |$))+$', '')"
_MAP = lambda d: "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in d.items()) + "}"
_FIRST_SQL = f"split_part({_PLAIN_SQL}, ' ', 1)"
_KEY_SQL = f"coalesce({_MAP(_FIRST)}[{_FIRST_SQL}], {_FIRST_SQL}) || replace(substr({_PLAIN_SQL}, length({_FIRST_SQL}) + 1), ' ', '')".replace("MAP {", "MAP {{").replace("'cj'}[", "'cj'}}[")
NORM_NAME_SQL = "(SELECT coalesce(" + _MAP(ALIASES).replace("{", "{{").replace("}", "}}") + "[_k], _k) FROM (SELECT " + _KEY_SQL + " AS _k))"


def coach_name(name: Column) -> Column:
    """Lower case with single blanks."""
    return F.lower(F.regexp_replace(F.trim(name), r"\s+", " "))
