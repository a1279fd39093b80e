"""Typed errors of the public surface."""


class LoreError(Exception):
    """Base of all errors raised on purpose."""


class WriteValidationError(LoreError):
    """A batch holds an invalid item; nothing of it was written."""


class InvalidFilterError(LoreError):
    """A filter names what may not be filtered on."""


class InvalidLimitError(LoreError, ValueError):
    """A limit outside what the verb accepts."""


class IllegalTransitionError(LoreError):
    """A lifecycle step that the state machine does not have."""

    def __init__(self, before: str, after: str, legal: list[str]):
        super().__init__(f"{before} -> {after} is not legal; from {before}: {legal}")
        self.before, self.after, self.legal = before, after, legal


class NotLifecycleAddressableError(LoreError):
    """Only logical ids have a lifecycle."""


class CollectionError(LoreError):
    """Unknown collection, wrong kind, or a payload that breaks its schema."""


class DenseUnavailableError(LoreError):
    """The vector arm cannot run: no embedder, or one that is not the vectors' own."""


class ProjectionError(LoreError):
    """A projection change that would destroy something without being told to."""


class ProviderError(LoreError):
    """A provider broke its contract."""
