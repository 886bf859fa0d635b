import sys

from waymill.cli import main

sys.exit(main())
