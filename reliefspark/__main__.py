"""python -m reliefspark INPUT OUT1 FUNCTION1 [OUT2 FUNCTION2 ...]"""

import logging
import sys

from reliefspark.plans.run import command

if __name__ == "__main__":
    logging.basicConfig(level=logging.INFO)
    sys.exit(command(sys.argv[1:]))
