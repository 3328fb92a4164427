"""The four kinds of refusal. Messages may repeat names of the request and configured bounds, never data."""


class SurvivalError(Exception):
    """Base of all of them."""


class UserInputError(SurvivalError):
    """The request, or a column that it names, is not usable."""


class PrivacyThresholdViolation(SurvivalError):
    """A site, or a category at a site, is too small to share aggregates."""


class PrivacyViolation(SurvivalError):
    """A guard cannot be applied, or a stage was called out of turn."""


class AlgorithmError(SurvivalError):
    """The protocol is broken: missing answers, impossible aggregates."""
