"""Word lists, patterns and tables whose values are part of the results.

All of these are fixed values: other numbers or words would change what a query
returns, so they are stated as plain text.
"""

# Russian stop words.
RU_STOP = """
и в во не что он на я с со как а то все она так его но да ты к у же вы
за бы по только ее мне было вот от меня еще нет о из ему теперь когда даже ну вдруг ли
если или быть был него до вас нибудь опять уж вам ведь там потом себя ничего ей может они
тут где есть надо ней для мы тебя их чем была сам чтоб без будто чего раз тоже себе под
будет ж тогда кто этот того потому этого какой совсем ним здесь этом один почти мой тем
чтобы нее сейчас были куда зачем всех никогда можно при наконец два об другой хоть после над
больше тот через эти нас про всего них какая много разве три эту моя впрочем свою этой перед
иногда лучше чуть том нельзя такой им более всегда конечно всю между это при также
""".split()

# English stop words and common fillers of abstracts.
EN_STOP = """
a an the and or but if of at by for with about against between into through
during before after above below to from up down in out on off over under again further then
once here there all any both each few more most other some such no nor not only own same so
than too very can will just is are was were be been being have has had do does did this that
these those it its as we you they he she i our your their his her them us were was which who
whom whose what when where why how using used use based study studies paper papers show shown
shows results result method methods approach via due within also may can could would should
et al fig table
""".split()

STOPWORDS = sorted(set(RU_STOP) | set(EN_STOP))

# Stop words of the library scorer.
LIBRARY_STOP = sorted(set("""
and are but for from into not that the their this with
это как для или при под над без что его ее её они
она оно так также если либо где чем чтобы когда после
перед между через очень были было быть есть нет про the
данные данных метод методы analysis study using
""".split()))

# Token patterns.
TOKEN_RE = r"[a-zа-я0-9][a-zа-я0-9\-]+"
LIBRARY_WORD_RE = r"(?!\d+(?![a-zа-я0-9\-]))[a-zа-я0-9\-]{3,}"

# Chemical symbols that a material query recognises.
ELEMENTS = """
H He Li Be B C N O F Ne Na Mg Al Si P S
Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga
Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd
Ag Cd In Sn Sb Te I Xe Cs Ba La Ce W Re Os
Ir Pt Au Hg Pb Bi Nd Sm Gd Ta Hf
""".split()

# File extension to file type, and the types that can be parsed.
FILE_TYPES = {
    ".pdf": "pdf", ".docx": "docx", ".xlsx": "xlsx", ".csv": "csv", ".txt": "txt",
    ".doc": "doc", ".png": "image", ".jpg": "image", ".jpeg": "image",
}
SUPPORTED_TYPES = ["pdf", "docx", "xlsx", "csv", "txt", "image"]

# Table classes and the words that point to them, tried in this order.
TABLE_CLASSES = [
    ("parameters", ["parameter", "setting", "input", "factor", "condition"]),
    ("experiments", ["experiment", "trial", "run", "sample id", "batch"]),
    ("results", ["result", "output", "yield", "score", "metric", "performance"]),
    ("compositions", ["composition", "alloy", "component", "element", "formula", "material"]),
    ("reference", ["reference", "lookup", "standard", "baseline", "catalog"]),
]

# Score axes and default ranking weights (risk enters as 100 - risk).
AXES = ["novelty", "value", "feasibility", "risk"]
DEFAULT_WEIGHTS = {"novelty": 0.25, "value": 0.30, "feasibility": 0.25, "risk": 0.20}

# Hypothesis states and their labels.
STATUS_LABELS = {
    "proposed": "Новая",
    "review": "На проверке",
    "accepted": "Подтверждена экспертом",
    "rejected": "Опровергнута экспертом",
}

# Source type labels of the context block.
SOURCE_TYPE_LABELS = {
    "literature": "литература", "report": "отчёт", "experiment": "эксперимент",
    "dataset": "набор данных", "uploaded_document": "загруженный документ",
}

# Retrieval parameters.
BM25_K1, BM25_B = 1.5, 0.75
RRF_K, RRF_BM25_WEIGHT, RRF_DENSE_WEIGHT = 60, 1.0, 1.0
POOL_BUDGET, POOL_MIN_PER_LANG = 24, 5
TOP_K, PER_SOURCE = 6, 1
PASSAGE_SIZE, PASSAGE_OVERLAP = 900, 150
CHUNK_SIZE, CHUNK_OVERLAP = 1600, 180
