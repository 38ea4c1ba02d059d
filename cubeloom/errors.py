"""Errors of the engine, all under one base."""


class CubeError(Exception):
    """Base of everything this library raises on purpose."""


class DefinitionError(CubeError):
    """A rollup is declared incompletely or against its rules."""


class AssociationError(DefinitionError):
    """A hop names an association the source doesn't have, or one that isn't many-to-one."""


class UnknownDimensionError(CubeError):
    """A read names a dimension the rollup doesn't have."""


class MissingTenantError(CubeError):
    """A read names no tenant and doesn't ask to cross tenants."""


class UnknownRollupError(CubeError):
    """No registered rollup has the name."""


class StaleSchemaError(CubeError):
    """The stored rollup has other columns than its declaration."""


class VerificationError(CubeError):
    """A rollup disagrees with its source where agreement was demanded, or a scope makes no sense."""


class ChangeLogOverflowError(CubeError):
    """More changes are pending than the configuration allows; rebuild instead of draining."""


class ConcurrentWriteError(CubeError):
    """Another writer committed the same version first."""
