"""Pieces of SQL shared by the oracles."""

from siftline.functions import vocab


def words(items) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in items) + "]"


def tokens(column: str) -> str:
    return (
        f"list_filter(regexp_extract_all(replace(lower({column}), 'ё', 'е'), '[a-zа-я0-9][a-zа-я0-9\\-]+'), "
        f"lambda t: NOT list_contains({words(vocab.STOPWORDS)}, t))"
    )


def collapse(column: str) -> str:
    return f"trim(regexp_replace({column}, '\\s+', ' ', 'g'))"


def lang(column: str) -> str:
    """Only Latin letters occur in the tables."""
    return (f"CASE WHEN length(regexp_replace(lower({column}), '[^a-zа-я]', '', 'g')) = 0 THEN 'other' "
            f"WHEN length(regexp_replace(lower({column}), '[^а-я]', '', 'g')) >= "
            f"length(regexp_replace(lower({column}), '[^a-z]', '', 'g')) THEN 'ru' ELSE 'en' END")


def letters(column: str) -> str:
    return f"length(regexp_replace({column}, '[^\\p{{L}}]', '', 'g'))"


def summary_key(column: str) -> str:
    return f"lower(regexp_replace(coalesce({column}, ''), '[^\\p{{L}}\\p{{N}}]', '', 'g'))"


HALF_UP_1 = "CAST(round(CAST(round({x}, 7) AS DECIMAL(18,7)), 1) AS DOUBLE)"


def half_up(x: str, digits: int) -> str:
    return f"CAST(round(CAST(round({x}, {digits + 6}) AS DECIMAL(28,{digits + 6})), {digits}) AS DOUBLE)"
