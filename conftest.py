"""Tests run with the repository on the path."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
