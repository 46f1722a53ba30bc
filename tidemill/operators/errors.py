"""Failures with a name under which the audit log records them."""


class PolicyViolation(Exception):
    """An error-level rule of a ruleset failed; nothing of the batch was written."""


class PlatformViolation(Exception):
    """One of the engine's own guarantees would be broken."""

    def __init__(self, policy: str, message: str, total: int | None = None):
        super().__init__(f"{policy}: {message}")
        self.policy, self.total = policy, total


class ConfigError(ValueError):
    """Everything that is wrong with a configuration, at once."""

    def __init__(self, problems: list[str]):
        super().__init__("invalid configuration:\n" + "\n".join(f"- {p}" for p in problems))
        self.problems = problems


class AmbiguousMerge(Exception):
    """Several incoming rows would change one stored row."""


class IncompatibleColumns(ValueError):
    """A write would change a column's type to one that does not hold the stored values."""


#: Policies that are always fatal.
PLATFORM = (
    "unstamped_file anchor_column_missing anchor_unparseable anchor_not_stamped anchor_wrong_type cast_silent_null "
    "empty_source_schema unexpected_columns event_time_invalid malformed_table unstamped_table stamped_table "
    "export_row_count_mismatch"
).split()
