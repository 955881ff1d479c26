from . import catalog as catalog
from . import runs as runs
