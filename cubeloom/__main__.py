import sys

from cubeloom.cli import main

sys.exit(main())
