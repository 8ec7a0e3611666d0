"""The core queries; filled by the modules imported here."""

from studyloom.plans import bank, documents, extras, layout, more, performance, requests, streams  # noqa: F401
