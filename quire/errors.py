"""Typed errors; ``code`` is stable and meant for callers, ``status`` the matching HTTP status."""

from __future__ import annotations


class QuireError(Exception):
    code, status = "error", 500


class ReferenceSyntaxError(QuireError, ValueError):
    code, status = "unparseable_reference", 400


class UnknownBook(ReferenceSyntaxError):
    code, status = "unknown_book", 404


class SearchQueryError(QuireError, ValueError):
    code, status = "invalid_search_query", 400


class InvalidParameter(QuireError, ValueError):
    code, status = "invalid_parameter", 422


class UnknownValue(QuireError, LookupError):
    """A name that is not among the known ones; ``known`` lists them."""

    status = 404

    def __init__(self, what: str, value: object, known=()):
        self.what, self.value, self.known = what, value, tuple(known)
        self.code = f"unknown_{what}"
        super().__init__(f"unknown {what} {value!r}" + (f"; known: {', '.join(map(str, self.known))}" if self.known else ""))


class NoVersesFound(QuireError, LookupError):
    code, status = "no_verses_found", 404


class NoMatch(QuireError, LookupError):
    code, status = "no_match", 404


class VectorGuardError(QuireError):
    code, status = "semantic_unavailable", 503


class ContractError(QuireError):
    """Input that breaks its contract, with the first offender."""

    code, status = "contract", 422
