import sys
from pathlib import Path

# The pipeline's test uses the brute-force forms of the other module.
sys.path.insert(0, str(Path(__file__).parent))
