class ReductionError(RuntimeError):
    """A reducer cannot be applied to this table."""


class ModelError(RuntimeError):
    """A classifier cannot be applied to this table."""
