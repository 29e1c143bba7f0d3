"""One family of failures: corrupt data stops a run, a natural absence does not."""


class FramelakeError(Exception):
    """Base of all failures of this package."""


class SchemaError(FramelakeError):
    """A document or row breaks its contract."""


class UnsupportedMediaError(FramelakeError):
    """A media file has a form that no operator handles."""


class DanglingReferenceError(FramelakeError):
    """A key points to a row that does not exist."""


class MediaTimeoutError(FramelakeError):
    """A media step took longer than its limit."""


class ExternalApiError(FramelakeError):
    """A remote model gave no usable answer."""


class ModelUnavailableError(FramelakeError):
    """A model that a plug-in needs is not present."""


class ModelDownloadError(FramelakeError):
    """A model could not be fetched."""
