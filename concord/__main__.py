import sys

from concord.cli import main

sys.exit(main())
