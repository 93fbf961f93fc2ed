"""Errors of the library. Spark's own analysis and run-time errors pass through."""


class QuillError(Exception):
    """Any error raised here."""


class InvalidId(QuillError, ValueError):
    """A name breaks the rules of its kind; ``problems`` holds every reason."""

    def __init__(self, *problems: str):
        super().__init__("; ".join(problems))
        self.problems = list(problems)


class SchemaMismatch(QuillError):
    """Given and wanted schemas differ; ``violations`` holds every reason."""

    def __init__(self, violations: list[str]):
        super().__init__("\n".join(violations))
        self.violations = violations


class DuplicateKeys(QuillError):
    """A merge source has more than one row for a key."""


class RequiredNull(QuillError):
    """A required column holds nulls."""


class JobTimeout(QuillError):
    """A job was cancelled after its time limit."""


class IllegalUpdate(QuillError):
    """A definition cannot become what is wanted without losing data."""
