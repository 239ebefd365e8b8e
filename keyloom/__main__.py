import sys

from keyloom.cli import main

sys.exit(main())
