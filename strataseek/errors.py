"""Errors by who has to act: the caller, the operator of the service, or nobody (a provider failed)."""


class StrataseekError(Exception):
    status = 500


class ValidationError(StrataseekError, ValueError):
    status = 400


class ConfigError(StrataseekError):
    pass


class ProviderError(StrataseekError):
    pass


class BackendError(StrataseekError):
    pass
