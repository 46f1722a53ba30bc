"""Names of the columns that the engine itself writes."""

PREFIX = "__"
SOURCE = "__SOURCE"
EXPORT_DATE = "__EXPORT_DATE"
RECORD_HASH = "__RECORD_HASH"
ANCHOR = "__ANCHOR_DT"
MODIFIED = "__LAST_MODIFIED_DT"
START = "__START_DATE"
END = "__END_DATE"
CURRENT = "__CURRENT_FLAG"
DELETED = "__DELETED_FLAG"

MARKERS = (SOURCE, EXPORT_DATE, RECORD_HASH)
HISTORY = (START, END, CURRENT, DELETED)
COMMENTS = {
    SOURCE: "Where the row came from: a file, or a table and the time it was read.",
    EXPORT_DATE: "The export (snapshot) that delivered the row.",
    RECORD_HASH: "SHA-256 over the row's own values.",
    ANCHOR: "When the source last changed the record.",
    MODIFIED: "When the engine last wrote the row.",
    START: "From when this version of the record holds.",
    END: "Until when this version holds; empty while it is open.",
    CURRENT: "Y if this is the current version of the record, else N.",
    DELETED: "Y if the record was deleted at the source, else N.",
}


def is_own(name: str) -> bool:
    return name.startswith(PREFIX)
