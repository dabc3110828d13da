
from tallysift.plans import catalogue, datasets  # noqa: F401
