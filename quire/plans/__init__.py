"""Named queries. Importing the package registers all of them."""

from quire.plans import registry  # noqa: F401  isort: skip
from quire.plans import calibration, corrections, outline, packages, review, sources, workflow  # noqa: F401
