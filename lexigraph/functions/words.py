"""Word lists and rule tables that decide which tokens carry meaning.

Fixed values: results depend on exactly these words, patterns and weights. They
are defaults; every function that uses them takes others.
"""

from __future__ import annotations

# --- fixed values: tokens that are never concepts -----------------------------

PLACEHOLDERS = """
self cls args kwargs tmp temp item value result data info ctx req res obj ptr
key val ret err msg idx num cnt src dst buf
len str int float bool list dict set tuple type none true false
def class return yield import from if else elif for while try except with
as in not and or is pass raise break continue global nonlocal lambda
""".split()

BUILTINS = """
abs all any ascii bin bool bytearray bytes callable chr classmethod compile complex delattr
dict dir divmod enumerate eval exec exit filter float format frozenset getattr globals
hasattr hash help hex id input int isinstance issubclass iter len list locals map max memoryview
min next object oct open ord pow print property quit range repr reversed round set
setattr slice sorted staticmethod str sum super tuple type vars zip
main init name doc file module class_ type_checking
""".split()

METHODS = """
split rsplit splitlines strip rstrip lstrip join lower upper title capitalize swapcase
casefold startswith endswith find rfind index rindex replace translate maketrans format
format_map encode decode isalpha isdigit isalnum isspace isupper islower istitle
isnumeric isdecimal isidentifier isprintable isascii center ljust rjust zfill expandtabs partition
rpartition count removeprefix removesuffix
append extend insert remove pop clear copy reverse sort
keys values items get setdefault update popitem fromkeys
add discard union intersection difference symmetric_difference issubset issuperset isdisjoint
read readline readlines write writelines seek tell flush close readable writable seekable fileno
init new del repr str bytes hash eq ne lt le gt ge bool len iter next call
enter exit getitem setitem delitem contains add_ sub_ mul_ div_
dumps loads dump load
acquire release wait notify run start join cancel result set_result
""".split()

MODULES = """
os sys re json datetime time math random logging logger functools itertools collections
typing pathlib subprocess threading asyncio concurrent multiprocessing queue socket http
urllib ssl hashlib hmac base64 binascii uuid io csv xml html email smtplib imaplib ftplib
ast inspect traceback warnings weakref copy pickle shelve sqlite sqlite3 shutil tempfile
glob fnmatch argparse configparser getpass getopt platform atexit signal errno gc ctypes struct
array enum abc contextlib dataclasses operator string textwrap unicodedata codecs
decimal fractions statistics secrets zlib gzip tarfile zipfile
pytest unittest mock doctest pdb ipdb requests httpx aiohttp numpy pandas yaml click
""".split()

FRAMEWORK = """
web ctx input header cookies setcookie seeother notfound internalerror badrequest unauthorized
forbidden found tempredirect redirect storage storify websafe form renderer render renderer_
application subapp loadhook unloadhook delegate GET POST PUT DELETE PATCH OPTIONS HEAD
infogami client config core plugin macro view public thingdict thingref
render_template template templates
fixture mark parametrize monkeypatch tmp_path tmpdir capsys capfd caplog
any literal cast overload final protocol typevar generic iterable iterator callable
mapping sequence optional union tuple_ dict_
""".split()

VERBS = """
get set find create update delete remove process handle fetch load save compute
validate check run build parse format convert transform encode decode read write
add make do send receive start stop open close init clean sort filter map
render display show hide enable disable generate register unregister install uninstall
configure setup reset clear push pop insert append extend test assert log
""".split()

ABBREVIATIONS = "ISBN OCLC LCCN DDC MARC API URL JSON HTML XML CSV HTTP".split()

# --- fixed values: function words of issue texts ------------------------------

STOPWORDS = """
the a an and or but if then else of to in on at by for with without into
from as is are was were be been being have has had do does did doing done
can cant cannot could couldnt should shouldnt would wouldnt will wont shall may might must
this that these those there here where when why how what which who whom whose
i me my we us our you your yours he him his she her it its they them their theirs
not no yes so too very just only also any some all none each every more most
less few many much such same other another than while during since until before after
above below up down out off over under again still ever never now then always
about around through between among against but however though although because due
issue bug feature request problem error doesnt isnt wasnt arent wont didnt havent
please trying tried want need see seen use using used
t s re ve ll m d
steps reproduce expected actual behavior version environment log logs traceback stack
""".split()

# --- fixed values: issue router; category, pattern, weight --------------------

ROUTER_RULES = [
    ("api_route", r"\b(POST|GET|PUT|DELETE|PATCH)\s+/\w", 1.0),
    ("api_route", r"/\w+/\w+\b.*\bendpoint", 0.8),
    ("api_route", r"\breturns?\s+\d{3}\b", 0.8),
    ("api_route", r"\broute\b", 0.6),
    ("api_route", r"\bhandler\b", 0.5),
    ("api_route", r"\b(list|search|add|delete|edit|books?|authors?|subjects?)\s+endpoint", 0.7),
    ("solr_search", r"\b[sS]olr\b", 1.0),
    ("solr_search", r"\breindex", 0.9),
    ("solr_search", r"\bindex\b.*\b(update|rebuild)", 0.8),
    ("solr_search", r"\bboolean\s+clause", 0.9),
    ("solr_search", r"\bsearch\s+(query|result|scheme|pipeline)", 0.8),
    ("solr_search", r"\bfacet\b", 0.7),
    ("solr_search", r"\bSolrQuery\b", 0.9),
    ("solr_search", r"\bwork.?search\b", 0.8),
    ("marc_catalog", r"\bMARC\b", 1.0),
    ("marc_catalog", r"\bISB[Nn]\b", 0.9),
    ("marc_catalog", r"\bOCLC\b", 0.9),
    ("marc_catalog", r"\bLCCN\b", 0.9),
    ("marc_catalog", r"\bDDC\b", 0.9),
    ("marc_catalog", r"\bcatalog\b", 0.7),
    ("marc_catalog", r"\bedition\b.*\b(match|merge|import)", 0.8),
    ("marc_catalog", r"\bauthor\b.*\b(match|record|disambig)", 0.8),
    ("marc_catalog", r"\bbibliograph", 0.8),
    ("marc_catalog", r"\badd.?book\b", 0.9),
    ("marc_catalog", r"\bimport.*\b(record|api|edition)", 0.7),
    ("marc_catalog", r"\bwikidata\b", 0.7),
    ("marc_catalog", r"\b(metadata|publisher|publish_date)\b.*\b(import|normalize)", 0.7),
    ("script_tool", r"\bscript\b", 0.8),
    ("script_tool", r"\bCLI\b", 0.9),
    ("script_tool", r"\b(command.?line|batch|scheduler?)\b", 0.8),
    ("script_tool", r"\bmonitor", 0.6),
    ("script_tool", r"\bupdater\b", 0.6),
    ("script_tool", r"\bmigration\b", 0.8),
    ("script_tool", r"\butility\b", 0.5),
    ("script_tool", r"\bdocker", 0.7),
    ("refactor", r"\brefactor", 1.0),
    ("refactor", r"\b(instead of|rather than)\b", 0.9),
    ("refactor", r"\breplace\b.*\bwith\b", 0.9),
    ("refactor", r"\bmigrate\b.*\b(to|from)\b", 0.8),
    ("refactor", r"\buse\b.*\binstead\b", 0.8),
    ("refactor", r"\bexceeds?\b.*\b(complex|threshold)", 0.7),
    ("refactor", r"\breorgani[sz]e\b", 0.6),
    ("ui_frontend", r"\bbanner\b", 0.9),
    ("ui_frontend", r"\bdisplay\b", 0.5),
    ("ui_frontend", r"\bUI\b", 0.8),
    ("ui_frontend", r"\bmarkdown\b", 0.8),
    ("ui_frontend", r"\btemplate\b", 0.7),
    ("ui_frontend", r"\bpartials?\b", 0.7),
    ("ui_frontend", r"\b(table.of.contents|toc)\b", 0.9),
    ("ui_frontend", r"\breading.?goal\b", 0.8),
    ("ui_frontend", r"\bmy.?books\b", 0.7),
    ("domain_logic", r"\blending\b", 0.9),
    ("domain_logic", r"\bwaiting.?list\b", 0.9),
    ("domain_logic", r"\bpatron\b", 0.8),
    ("domain_logic", r"\b(borrow|loan)\b", 0.8),
    ("domain_logic", r"\bbooknotes?\b", 0.9),
    ("domain_logic", r"\breading.?log\b", 0.8),
    ("domain_logic", r"\bobservations?\b", 0.7),
    ("domain_logic", r"\b(ratings?|bookshelves?)\b", 0.7),
]
GENERAL = ("general", 0.3)
CATEGORY_ALPHA = {"marc_catalog": 0.75, "solr_search": 0.70, "script_tool": 0.70, "refactor": 0.60, "api_route": 0.45, "ui_frontend": 0.35, "domain_logic": 0.30, "general": 0.50}
LEXICAL_FIRST = ("marc_catalog", "solr_search", "script_tool", "refactor")
FOCUS = {
    "api_route": ["plugins", "fastapi"],
    "solr_search": ["solr", "plugins/worksearch"],
    "marc_catalog": ["catalog", "core"],
    "script_tool": ["scripts"],
    "ui_frontend": ["fastapi"],
    "domain_logic": ["core"],
}

# --- fixed values: multi-label issue types ------------------------------------

ISSUE_TYPES = {
    "api": [r"\b(POST|GET|PUT|DELETE)\s+/\w", r"/lists?/", r"/search", r"/books?/", r"endpoint", r"API", r"returns? \d{3}", r"route", r"request"],
    "search": [r"\bsolr\b", r"\bindex\b", r"\breindex", r"\bquery\b", r"\bsearch\b", r"\bSolr\b", r"boolean clause", r"facet", r"document\b"],
    "catalog": [r"\bMARC\b", r"\bcatalog\b", r"\bimport\b.*\brecord", r"\bISBN\b", r"\bOCLC\b", r"\bbibliograph", r"\bmetadata\b", r"\bedition\b", r"\bauthor\b.*\bmatch", r"\bpubli[sc]h", r"\badd_book\b"],
    "script": [r"\bscript\b", r"\bCLI\b", r"\bbatch\b", r"\bscheduler\b", r"\bimport\b.*\bscript\b", r"\bmonitor", r"\bupdater\b", r"\bmigration\b", r"\butility\b"],
    "refactor": [r"\brefactor\b", r"\binstead of\b", r"\breplace\b.*\bwith\b", r"\buse\b.*\binstead\b", r"\bmigrate\b.*\bto\b", r"\bexceeds?\b.*\bcomplex"],
    "ui": [r"\bbanner\b", r"\bdisplay\b", r"\bUI\b", r"\bpages?\b.*\bshow", r"\bmarkdown\b", r"\btemplate\b", r"\bpartials?\b"],
}

# ------------------------------------------------------------------------------


def blocklist() -> list[str]:
    """All tokens that never are concepts, each once."""
    return sorted({*PLACEHOLDERS, *BUILTINS, *METHODS, *MODULES, *FRAMEWORK})
